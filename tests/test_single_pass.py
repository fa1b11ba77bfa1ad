"""Pieces are split once, texts are encoded and decoded in their row, closures are cut as compressed columns."""

import contextlib
import io
import random

import numpy as np
import pytest

from tokscope.operators.encode import _decode_by_join, decode_sequences
from tokscope.operators.frequency import token_frequency
from tokscope.operators.subwords import LONG, _path_ends, best_path, best_tokens, longest_match
from tokscope.operators.tokenizer import SparkTokenizer, _encoded_by_pieces, encode_documents
from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_TOKENIZER, FIXTURE_UNIGRAM_TOKENIZER, FIXTURE_WORDPIECE_TOKENIZER, cut_columns
from tokscope.sources.vocab import vocab_with_bytes


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(20)] + ["th" * (3 * LONG), "na\u00efve \u6839 it's", "", None]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_counting_reads_the_corpus_once(spark, corpus):
    tok = SparkTokenizer(spark, FIXTURE_BYTE_LEVEL_TOKENIZER)
    assert _plan(token_frequency(corpus, tok)).count("ReadSchema: struct<text:string>") == 1


def test_texts_are_encoded_and_decoded_without_a_shuffle(spark, corpus):
    tok = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    ids = encode_documents(corpus, tok.spec, tok.merges, tok.vocab)
    text = decode_sequences(ids, vocab_with_bytes(tok.vocab), "doc_id")
    assert "Exchange" not in _plan(text)
    assert text.count() == corpus.count()


@pytest.mark.parametrize("path", [FIXTURE_TOKENIZER, FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_WORDPIECE_TOKENIZER, FIXTURE_UNIGRAM_TOKENIZER])
def test_rows_and_distinct_pieces_give_the_same_ids(spark, corpus, path):
    tok = SparkTokenizer(spark, path)
    # Repeated and null keys keep what they had: pieces of one key go together.
    docs = corpus.unionByName(corpus.filter("doc_id < 3")).unionByName(corpus.filter("doc_id = 4").selectExpr("cast(null as long) doc_id", "text"))
    got = encode_documents(docs, tok.spec, tok.merges, tok.vocab)
    want = _encoded_by_pieces(docs, tok.spec, tok.merges, tok.vocab, "doc_id", "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_decoding_rows_and_joins_agree(spark):
    vocab = spark.createDataFrame([(0, bytearray(b" \xe6\xa0")), (1, bytearray(b"\xb9")), (2, None)], "token_id int, raw_bytes binary")
    seqs = spark.createDataFrame([(1, [0, 1]), (1, [1, 0]), (2, [0, None, 9, -1]), (3, None), (None, [1]), (None, [0])], "k long, ids array<int>")
    got = decode_sequences(seqs, vocab, "k").collect()
    want = _decode_by_join(seqs, vocab.selectExpr("token_id", "hex(raw_bytes) hx"), "k", "ids", None).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_models_on_one_piece():
    known = {"th", "the", "##e", "##r"}
    assert longest_match("ther", known, "##", "[UNK]", 4, 100) == ["the", "##r"]
    assert longest_match("thex", known, "##", "[UNK]", 4, 100) == longest_match("thee", known, "##", "[UNK]", 4, 3) == ["[UNK]"]
    rng = random.Random(3)
    for _ in range(200):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): rng.randint(-8, 0) / 4 for _ in range(6)}
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        places = [(i, j, scores[text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in scores]
        first, last, values = (np.array(x) for x in zip(*places)) if places else (np.zeros(0, int),) * 3
        ends = _path_ends(best_path(len(text), first, last, values, -20.0))
        assert best_tokens(text, scores, 3, -20.0) == [text[a:b] for a, b in zip([0, *ends], ends)]


def test_cut_columns_are_compressed(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")
    cut = cut_columns(df)
    assert all(f.endswith(".zstd.parquet") for f in cut.inputFiles()) and sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
