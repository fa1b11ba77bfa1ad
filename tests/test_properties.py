"""Properties: byte conservation, entropy bound, brute-force agreement."""

import math
import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tokscope.operators.bytematch import corpus_token_metrics
from tokscope.operators.encode import TiktokenEncoder, encode_column
from tokscope.operators.frequency import token_frequency
from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.session import FIXTURE_TOKENIZER
from tokscope.sources.vocab import load_vocab, read_tokenizer, vocab_with_bytes

SF = "/root/testdata/sf0.01"


def test_token_bytes_cover_corpus_exactly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab = vocab_with_bytes(load_vocab(read_tokenizer(spark, FIXTURE_TOKENIZER)))
    freq = token_frequency(docs, SparkTokenizer(spark, FIXTURE_TOKENIZER))
    covered = freq.join(vocab, "token_id").agg(F.sum(F.col("count") * F.octet_length("token_bytes"))).first()[0]
    total = docs.agg(F.sum(F.octet_length(F.encode("text", "UTF-8")))).first()[0]
    assert covered == total


def test_entropy_and_ratio_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab = vocab_with_bytes(load_vocab(read_tokenizer(spark, FIXTURE_TOKENIZER)))
    m = corpus_token_metrics(docs, vocab)
    bad = m.filter(
        (F.col("entropy") < 0)
        | (F.col("entropy") > math.log2(512) + 1e-9)
        | (F.col("standalone_ratio") < 0)
        | (F.col("standalone_ratio") > 1)
    ).count()
    assert bad == 0


def test_failed_encoder_rows_are_counted(spark):
    class Flaky(TiktokenEncoder):
        def encode_batch(self, texts):
            return [None if "bad" in t else [len(t)] for t in texts]

    obs = Observation("enc")
    df = spark.createDataFrame([("ok",), ("bad row",), ("fine",)], "text string")
    out = encode_column(df, Flaky(), "text", observation=obs)
    assert out.filter(F.col("ids").isNotNull()).count() == 2
    assert obs.get == {"failed": 1, "rows": 3}


def _brute(texts, tokens):
    freq, stand, nb = Counter(), Counter(), defaultdict(lambda: (Counter(), Counter()))
    pats = {t.encode() for t in tokens if t}
    for text in texts:
        b = text.encode()
        for p in pats:
            for m in re.finditer(b"(?=" + re.escape(p) + b")", b):
                i, j = m.start(), m.start() + len(p)
                left = b[i - 1] if i > 0 else None
                right = b[j] if j < len(b) else None
                freq[p] += 1
                if left is not None:
                    nb[p][0][left] += 1
                if right is not None:
                    nb[p][1][right] += 1
                if left is not None and right is not None and not 32 <= left <= 126 and not 32 <= right <= 126:
                    stand[p] += 1
    return freq, stand, nb


alphabet = st.sampled_from(list("ab \nxé根\t"))


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text(alphabet, min_size=0, max_size=30), min_size=1, max_size=4),
    tokens=st.lists(st.text(alphabet, min_size=1, max_size=4), min_size=1, max_size=6, unique=True),
    seg=st.integers(min_value=1, max_value=8),
)
def test_byte_match_equals_brute_force(spark, texts, tokens, seg):
    vocab = spark.createDataFrame(
        [(i, t, bytearray(t.encode()), t) for i, t in enumerate(tokens)],
        "token_id int, token string, token_bytes binary, decoded string",
    )
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.token_id: r for r in corpus_token_metrics(docs, vocab, max_segment_bytes=seg).collect()}
    freq, stand, nb = _brute(texts, tokens)
    for i, t in enumerate(tokens):
        p = t.encode()
        assert got[i].freq_in_corpus == freq.get(p, 0)
        assert abs(got[i].standalone_ratio - stand.get(p, 0) / (freq.get(p, 0) + 1e-6)) < 1e-12
        hist = list(nb[p][0].values()) + list(nb[p][1].values()) if p in nb else []
        tot = sum(hist)
        ent = 0.0 if tot == 0 else -sum(c / tot * math.log2(c / tot) for c in hist)
        assert abs(got[i].entropy - ent) < 1e-9


def _pack_reference(lengths, threshold):
    packs, cur, run = [], [], 0
    for i, n in enumerate(lengths):
        cur.append(i)
        run += n
        if run >= threshold:
            packs.append(cur)
            cur, run = [], 0
    if cur:
        packs.append(cur)
    return packs


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lengths=st.lists(st.integers(min_value=1, max_value=9), min_size=1, max_size=25),
    threshold=st.integers(min_value=1, max_value=20),
)
def test_batch_by_chars_matches_sequential_packing(spark, lengths, threshold):
    from tokscope.operators.batching import batch_by_chars

    texts = ["x" * n for n in lengths]
    df = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.n_docs, r.n_chars) for r in batch_by_chars(df, threshold).orderBy("pack_no").collect()]
    want = [(len(p), sum(lengths[i] for i in p)) for p in _pack_reference(lengths, threshold)]
    assert got == want


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lengths=st.lists(st.integers(min_value=1, max_value=12), min_size=1, max_size=60),
    threshold=st.integers(min_value=1, max_value=15),
    seg=st.integers(min_value=1, max_value=20),
)
def test_batch_by_chars_exact_across_segments(spark, lengths, threshold, seg):
    from tokscope.operators.batching import batch_by_chars

    texts = ["y" * n for n in lengths]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [(r.pack_no, r.n_docs, r.n_chars) for r in batch_by_chars(df, threshold, segment_docs=seg).orderBy("pack_no").collect()]
    want = [(i, len(p), sum(lengths[j] for j in p)) for i, p in enumerate(_pack_reference(lengths, threshold))]
    assert got == want


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(st.sampled_from(list("ab 1,\n\té根!\x01\u00a0")), min_size=1, max_size=80))
def test_native_ids_random(spark, text):
    from tokenizers import Tokenizer

    from tokscope.operators.tokenizer import encode_documents

    tok = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = Tokenizer.from_str(tok.spec.text).encode(text, add_special_tokens=False).ids
    assert encode_documents(df, tok.spec, tok.merges, tok.vocab).first().ids == want


def test_empty_corpus(spark):
    from tokscope.operators.batching import batch_by_chars, batch_by_count, chunk_fixed
    from tokscope.operators.ranking import entropy_rank_curve

    empty = spark.createDataFrame([], "doc_id long, text string")
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    vocab = vocab_with_bytes(load_vocab(read_tokenizer(spark, FIXTURE_TOKENIZER)))
    enc = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    for docs in (empty, nulls):
        assert token_frequency(docs, enc).count() == 0
        m = corpus_token_metrics(docs, vocab)
        assert m.filter("freq_in_corpus > 0").count() == 0 and m.count() == vocab.count()
        assert m.filter("not meaningless").count() == 0
        assert batch_by_count(docs, 3).count() == 0
        assert batch_by_chars(docs, 10).count() == 0
        assert chunk_fixed(docs, 4).count() == 0
        assert entropy_rank_curve(m).count() == vocab.count()


def test_empty_graph_and_degenerate_vocab(spark):
    from tokscope.operators.encode import decode_sequences
    from tokscope.operators.mergegraph import closure_adjacency, merge_closure, merge_edges
    from tokscope.operators.ranking import descendant_frequency

    vocab = spark.createDataFrame([(0, "a", False), (1, "b", False)], "token_id int, token string, special boolean")
    merges = spark.createDataFrame([], "rank int, left string, right string")
    edges, unresolved = merge_edges(merges, vocab)
    closure = merge_closure(edges)
    assert closure.count() == 0 and closure_adjacency(closure).count() == 0 and unresolved.count() == 0
    filled = spark.createDataFrame([(0, 3), (1, 0)], "token_id int, freq long")
    assert {r.token_id: r.descendant_freq for r in descendant_frequency(closure, filled).collect()} == {0: 0, 1: 0}

    only_empty = spark.createDataFrame([(0, "", bytearray(b""), "")], "token_id int, token string, token_bytes binary, decoded string")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    m = corpus_token_metrics(docs, only_empty).collect()
    assert len(m) == 1 and m[0].freq_in_corpus == 0 and m[0].meaningless

    vb = spark.createDataFrame([(0, bytearray(b"x"))], "token_id int, raw_bytes binary")
    seqs = spark.createDataFrame([(1, [0, 99, 0])], "k long, ids array<int>")
    assert decode_sequences(seqs, vb, "k").first().text == "xx"
