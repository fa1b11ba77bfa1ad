"""Stretches of pieces between borders that no token holds, and pieces cut as plain strings."""

import contextlib
import io
import re

import pytest

from tokscope.operators.subwords import tokens_to_ids
from tokscope.operators.tokenizer import SparkTokenizer, _stretch_pattern, bpe_frequency, bpe_tokens, piece_counts, split_pieces, stretch_counts
from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_TOKENIZER

TEXTS = ["the thing and then, an0ther\t[UNK]on the[UNK] naïve 根 it's  \n", "\x01th\x02e\x03 😀the", "th" * 300, "", None, "[UNK]", "Anblewh 12 !?"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_a_stretch_ends_where_no_token_goes_on():
    pattern = _stretch_pattern(["th", "the", "an"])
    assert re.findall(pattern, "thanthe\nx") == ["th", "an", "the", "\n", "x"]
    assert _stretch_pattern([]) is None
    assert _stretch_pattern([chr(200 + i) + chr(400 + i) for i in range(65)]) is None


@pytest.mark.parametrize("path", [FIXTURE_TOKENIZER, FIXTURE_BYTE_LEVEL_TOKENIZER])
def test_stretches_have_the_tokens_of_their_pieces(spark, path):
    tok = SparkTokenizer(spark, path)
    docs = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string")
    counts = piece_counts(docs, tok.spec)
    whole = tokens_to_ids(bpe_tokens(counts, tok.spec, tok.merges, tok.vocab), tok.spec).selectExpr("explode(ids) token_id", "n").groupBy("token_id").sum("n")
    assert tok.spec.stretch and sorted(map(tuple, bpe_frequency(counts, tok.spec, tok.merges, tok.vocab).collect())) == sorted(map(tuple, whole.collect()))
    parts = {r.piece for r in stretch_counts(counts, tok.spec).collect()}
    assert max(map(len, parts)) == 600 and "" not in parts


@pytest.mark.parametrize("path", [FIXTURE_TOKENIZER, FIXTURE_BYTE_LEVEL_TOKENIZER])
def test_pieces_with_and_without_places_agree(spark, path):
    spec = SparkTokenizer(spark, path).spec
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = split_pieces(docs, spec, keep=("doc_id",))
    placed = split_pieces(docs, spec, keep=("doc_id",), position="pos")
    assert plain.columns == ["doc_id", "piece", "is_added"]
    assert sorted(map(tuple, plain.collect())) == sorted((r.doc_id, r.piece, r.is_added) for r in placed.collect())
    # Pieces are exploded as strings, not as structs built one by one.
    assert "lambdafunction(struct(t" not in _plan(plain).split("Generate")[-1]
