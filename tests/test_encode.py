"""Native encoding against the tokenizer library."""

import json

import public_tokenizers
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokscope.operators.encode import HFTokenizerEncoder, TiktokenEncoder, decode_sequences, encode_column
from tokscope.operators.frequency import distinct_token_count, token_frequency, token_frequency_whole_text, top_k
from tokscope.operators.tokenizer import RankFile, SparkTokenizer, bpe_ids, bpe_tokens, encode_documents, parse_spec, piece_counts, split_pieces
from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_TOKENIZER

SF = "/root/testdata/sf0.001"
ODD = [
    "",
    "hello<sep>world <sep> done",
    "bbb   ccc\n\n  c 12345,67 x\x01y\x02z naïve 漢字",
    "it's  we'll\t\tx  ",
    "   ",
    "Ⅷ ½ ０１ 😀👍🏽",
    "hello world 12345 and 67",
    "q" * 2000,
    "<sep><sep>x<|endoftext|>",
]


def _file(path):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _added(i, text, normalized=False):
    return {"id": i, "content": text, "single_word": False, "lstrip": False, "rstrip": False, "normalized": normalized, "special": False}


def _split(pattern, base=FIXTURE_TOKENIZER):
    conf = _file(base)
    conf["pre_tokenizer"] = {"type": "Split", "pattern": pattern, "behavior": "Isolated", "invert": False}
    return conf


def _variants():
    byte = _file(FIXTURE_BYTE_LEVEL_TOKENIZER)
    yield "characters", _file(FIXTURE_TOKENIZER)
    yield "byte level", byte
    yield "50,000 merges", _file(public_tokenizers.path("byte_bpe_50k.json"))
    yield "digits", _split({"Regex": r"\p{N}{1,3}"})
    yield "one space", _split({"String": " "})
    added = _file(FIXTURE_BYTE_LEVEL_TOKENIZER)
    added["added_tokens"] = [_added(500, "<sep>"), _added(501, "<sep><sep>", True), _added(502, "hello<")]
    yield "added tokens", added
    two = _file(FIXTURE_BYTE_LEVEL_TOKENIZER)
    two["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [_split({"Regex": r"\p{N}"})["pre_tokenizer"], byte["pre_tokenizer"]]}
    yield "two splits", two
    none = _file(FIXTURE_TOKENIZER)
    none["pre_tokenizer"] = None
    yield "no split", none
    whole = _file(public_tokenizers.path("byte_bpe_50k.json"))
    whole["model"]["ignore_merges"] = True
    yield "ignore merges", whole


VARIANTS = dict(_variants())


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()
    return [*ODD, *(r.text for r in docs)]


@pytest.mark.parametrize("name", VARIANTS)
def test_ids_equal_the_library(spark, tmp_path, texts, name):
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(VARIANTS[name]), encoding="utf-8")
    tok = SparkTokenizer(spark, str(path))
    assert tok.spec.native, tok.spec.reason
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.ids for r in encode_documents(df, tok.spec, tok.merges, tok.vocab).collect()}
    want = Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)
    for i, e in enumerate(want):
        assert got[i] == e.ids, texts[i][:80]
    counts = {r.token_id: r["count"] for r in token_frequency(df, tok).collect()}
    flat = [x for e in want for x in e.ids]
    assert counts == {x: flat.count(x) for x in set(flat)}


def test_rank_file_equals_the_library(spark, texts):
    """Rank-file encoding in Spark against the library that defines it."""
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = RankFile(spark, path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.ids for r in encode_documents(df, tok.spec, tok.merges, tok.vocab).collect()}
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t), t[:80]


def test_long_text_is_split_whole(spark, tmp_path):
    # Two million characters, with white space that a cut would split differently.
    text = ("bbb   ccc 12,5 and  more\n" * 80_000)[:2_000_000]
    tok = SparkTokenizer(spark, FIXTURE_BYTE_LEVEL_TOKENIZER)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.token_id: r["count"] for r in token_frequency(df, tok).collect()}
    ids = Tokenizer.from_file(FIXTURE_BYTE_LEVEL_TOKENIZER).encode(text, add_special_tokens=False).ids
    want = {}
    for x in ids:
        want[x] = want.get(x, 0) + 1
    assert got == want


def test_pieces_are_the_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("digits", "one space", "added tokens", "two splits"):
        spec = parse_spec(json.dumps(VARIANTS[name]))
        rows = split_pieces(df, spec, keep=("doc_id",), position="pos").collect()
        for i, t in enumerate(texts):
            assert "".join(r.piece for r in sorted(rows, key=lambda r: r.pos) if r.doc_id == i) == t


def test_what_cannot_be_reproduced_is_said():
    cases = [
        ({"normalizer": {"type": "Precompiled"}}, "normalizer Precompiled"),
        ({"pre_tokenizer": {"type": "UnicodeScripts"}}, "pre-tokenizer UnicodeScripts"),
        ({"pre_tokenizer": {"type": "Split", "pattern": {"Regex": " "}, "behavior": "MergedWithNext", "invert": False}}, "MergedWithNext"),
        ({"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "a*"}, "behavior": "Isolated", "invert": False}}, "match nothing"),
        ({"normalizer": {"type": "Lowercase"}, "added_tokens": [{**_added(500, "<X>"), "normalized": True}]}, "is normalized"),
        ({"added_tokens": [{**_added(500, "<x>"), "lstrip": True}]}, "surroundings"),
    ]
    for change, reason in cases:
        spec = parse_spec(json.dumps({**_file(FIXTURE_TOKENIZER), **change}))
        assert not spec.native and reason in spec.reason
    conf = _file(FIXTURE_TOKENIZER)
    conf["model"]["byte_fallback"] = True
    assert "byte_fallback" in parse_spec(json.dumps(conf)).reason


def test_other_tokenizers_are_encoded_whole(spark, tmp_path):
    conf = _file(public_tokenizers.path("word_bpe_49k.json"))
    conf["pre_tokenizer"] = {"type": "UnicodeScripts"}
    path = str(tmp_path / "tokenizer.json")
    (tmp_path / "tokenizer.json").write_text(json.dumps(conf), encoding="utf-8")
    tok = SparkTokenizer(spark, path)
    assert not tok.spec.native
    texts = ["Hello  World, it's 42", "naïve CAFÉ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    seen = Observation("seen")
    got = {r.token_id: r["count"] for r in token_frequency(df, tok, observation=seen).collect()}
    ids = [x for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False) for x in e.ids]
    assert got == {x: ids.count(x) for x in ids} and seen.get == {"failed": 0, "rows": 2}


def test_tokens_concatenate_to_the_piece(spark):
    tok = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pieces = piece_counts(docs, tok.spec)
    tokens = bpe_tokens(pieces, tok.spec, tok.merges, tok.vocab)
    assert tokens.filter(F.array_join("tokens", "") != F.col("piece")).count() == 0
    ids = bpe_ids(pieces, tok.spec, tok.merges, tok.vocab)
    assert ids.count() == pieces.count()


def test_unknown_characters_map_to_unk(spark):
    tok = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    docs = spark.createDataFrame([(1, "x 根 y")], "doc_id long, text string")
    got = {r.token_id: r["count"] for r in token_frequency(docs, tok).collect()}
    want = {r.token_id: r["count"] for r in token_frequency_whole_text(docs, HFTokenizerEncoder.from_text(tok.spec.text)).collect()}
    assert got == want and got.get(tok.spec.unk_id) == 1
    assert distinct_token_count(token_frequency(docs, tok)).first()[0] == len(got)


def test_top_k_tie_break(spark):
    df = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, 1)], "token_id int, count long")
    assert [r.token_id for r in top_k(df, 3).collect()] == [2, 1, 3]


def test_tiktoken_plugin_with_local_encoding(spark):
    """A tiktoken encoding runs through the same encoder operator."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for extra in (b"th", b"the", b" the"):
        ranks[extra] = len(ranks)
    enc = tiktoken.Encoding(name="local-test", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})

    class LocalTiktoken(TiktokenEncoder):
        def _get(self):
            return enc

    df = spark.createDataFrame([(1, "the theme"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_column(df, LocalTiktoken(), "text").collect()}
    assert got[1] == [ranks[b"the"], ranks[b" the"], ranks[b"m"], ranks[b"e"]]
    assert got[2] == [] and got[3] is None


def test_distinct_count_approx(spark):
    df = spark.range(0, 5000).select((F.col("id") % 700).alias("token_id"))
    assert distinct_token_count(df).first()[0] == 700
    assert abs(distinct_token_count(df, approx=True).first()[0] - 700) <= 35


def test_decode_sequences_joins_partial_bytes(spark):
    vocab = spark.createDataFrame(
        [(0, bytearray(b" \xe6\xa0")), (1, bytearray(b"\xb9")), (2, bytearray(b"x"))], "token_id int, raw_bytes binary"
    )
    seqs = spark.createDataFrame([(1, [0, 1]), (2, [0]), (3, [2, 0, 1, 2]), (4, [])], "k long, ids array<int>")
    got = {r.k: r.text for r in decode_sequences(seqs, vocab, "k").collect()}
    assert got[1] == " 根" and got[2] == " �" and got[3] == "x 根x"
    assert got[4] == ""
