"""Literal cases and an independent automaton brute force."""

import math
from collections import Counter, defaultdict

import ahocorasick
import pytest

from tokscope.operators.bytematch import corpus_token_metrics

from .conftest import SF_SMALL


def _vocab(spark, tokens):
    rows = [(i, t, bytearray(t.encode()), t) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "token_id int, token string, token_bytes binary, decoded string")


def _metrics(spark, docs, tokens):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    m = corpus_token_metrics(d, _vocab(spark, tokens)).collect()
    return {r.token_id: r for r in m}


def test_overlapping_matches(spark):
    m = _metrics(spark, ["baaa"], ["a", "aa", "ba"])
    assert [m[i].freq_in_corpus for i in range(3)] == [3, 2, 1]


def test_empty_pattern_never_matches(spark):
    m = _metrics(spark, ["abc"], ["", "a"])
    assert m[0].freq_in_corpus == 0 and m[0].meaningless is True
    assert m[1].freq_in_corpus == 1


@pytest.mark.parametrize("doc,expected", [("\nx\n", 1.0), (" x ", 0.0), ("x", 0.0)])
def test_standalone(spark, doc, expected):
    m = _metrics(spark, [doc], ["x"])
    assert m[0].freq_in_corpus == 1
    assert m[0].standalone_ratio == pytest.approx(expected / (1 + 1e-6))


def test_entropy_edges(spark):
    assert _metrics(spark, ["x"], ["x"])[0].entropy == 0.0
    assert _metrics(spark, ["axb"], ["x"])[0].entropy == pytest.approx(1.0)
    # Left 'a' and right 'a' are two symbols of one histogram.
    assert _metrics(spark, ["axa"], ["x"])[0].entropy == pytest.approx(1.0)


def test_duplicate_bytes_give_duplicate_rows(spark):
    m = _metrics(spark, ["aa"], ["a", "a"])
    assert len(m) == 2 and m[0].freq_in_corpus == m[1].freq_in_corpus == 2


def test_control_token_meaningless(spark):
    m = _metrics(spark, ["a\x01b " * 20], ["\x01", "a"])
    assert m[0].freq_in_corpus == 20 and m[0].meaningless is True


def _entropy(counts):
    t = sum(counts)
    return 0.0 if t == 0 else -sum(c / t * math.log2(c / t) for c in counts if c)


def test_against_automaton_on_fixture_corpus(spark):
    from tokscope.session import FIXTURE_TOKENIZER, read_table
    from tokscope.sources.vocab import load_vocab, read_tokenizer, vocab_with_bytes

    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    vocab = vocab_with_bytes(load_vocab(read_tokenizer(spark, FIXTURE_TOKENIZER)))
    got = {r.token_id: r for r in corpus_token_metrics(docs.repartition(4), vocab).collect()}
    vb = {r.token_id: bytes(r.token_bytes) for r in vocab.select("token_id", "token_bytes").collect()}

    auto = ahocorasick.Automaton()
    for tb in set(vb.values()):
        if tb:
            auto.add_word(tb.decode("latin-1"), tb)
    auto.make_automaton()
    freq, stand, nb = Counter(), Counter(), defaultdict(lambda: (Counter(), Counter()))
    for (text,) in docs.select("text").collect():
        s = text.encode("utf-8").decode("latin-1")
        for end, tb in auto.iter(s):
            start = end - len(tb) + 1
            left = ord(s[start - 1]) if start > 0 else None
            right = ord(s[end + 1]) if end + 1 < len(s) else None
            freq[tb] += 1
            if left is not None:
                nb[tb][0][left] += 1
            if right is not None:
                nb[tb][1][right] += 1
            if left is not None and right is not None and not 32 <= left <= 126 and not 32 <= right <= 126:
                stand[tb] += 1
    assert sum(freq.values()) > 100_000
    for tid, tb in vb.items():
        r = got[tid]
        assert r.freq_in_corpus == freq.get(tb, 0)
        assert r.standalone_ratio == pytest.approx(stand.get(tb, 0) / (freq.get(tb, 0) + 1e-6), abs=1e-12)
        hist = list(nb[tb][0].values()) + list(nb[tb][1].values()) if tb in nb else []
        assert r.entropy == pytest.approx(_entropy(hist), abs=1e-9)
        assert r.length_bytes == len(tb)


def test_frequency_independent_of_partitioning(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    v = _vocab(spark, ["e", "th", " the", "ing", "\n"])
    a = corpus_token_metrics(d.repartition(1), v).select("token_id", "freq_in_corpus").collect()
    b = corpus_token_metrics(d.repartition(7), v).select("token_id", "freq_in_corpus").collect()
    assert sorted(a) == sorted(b)
    assert all(r.freq_in_corpus > 0 for r in a)


@pytest.mark.parametrize("seg", [1, 2, 3, 5, 17])
def test_long_documents_segmented_exactly(spark, seg):
    docs = ["baaab\naab a", "x", "aaaaaaaaaaaaaaaaaaaaab", "ab\x01ab"]
    tokens = ["a", "aa", "ab", "baa", "aaaab", "\x01"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    whole = corpus_token_metrics(d, _vocab(spark, tokens), max_segment_bytes=10_000).collect()
    cut = corpus_token_metrics(d, _vocab(spark, tokens), max_segment_bytes=seg).collect()
    key = lambda r: r.token_id
    assert sorted(whole, key=key) == sorted(cut, key=key)


def test_raw_bytes_with_invalid_utf8(spark, tmp_path):
    from tokscope.sources.tables import scan_bytes

    p = tmp_path / "corpus.bin"
    p.write_bytes(b"ab\xe6\xa0 ab\xff\n\xe6\xa0\xb9ab")
    raw = scan_bytes(spark, str(p))
    vocab = spark.createDataFrame(
        [(0, "ab", bytearray(b"ab"), "ab"), (1, "�", bytearray(b"\xe6\xa0"), "�")],
        "token_id int, token string, token_bytes binary, decoded string",
    )
    got = {r.token_id: r.freq_in_corpus for r in corpus_token_metrics(raw, vocab, text_col="bytes").collect()}
    assert got == {0: 3, 1: 2}
