"""Byte-level BPE (GPT-2 style alphabet and pre-token pattern with look-ahead)."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

from tokscope.operators.bytematch import corpus_token_metrics
from tokscope.operators.encode import HFTokenizerEncoder
from tokscope.operators.frequency import token_frequency, token_frequency_whole_text
from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.sources.vocab import load_vocab, vocab_with_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_level_json():
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").to_pylist()
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    tok.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=600, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False
    )
    tok.train_from_iterator(texts + ["the cat’s ünïcödé 根 text"], trainer=trainer)
    return tok.to_str()


def test_distinct_pieces_equal_whole_text(spark, byte_level_json, tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text(byte_level_json, encoding="utf-8")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(9999, "it's  the 根 cat's\n\n  end ")], "doc_id long, text string")
    )
    a = {r.token_id: r["count"] for r in token_frequency(docs, SparkTokenizer(spark, str(path))).collect()}
    b = {r.token_id: r["count"] for r in token_frequency_whole_text(docs, HFTokenizerEncoder(byte_level_json)).collect()}
    assert a == b and len(a) > 100


def test_byte_level_vocab_metrics(spark, byte_level_json):
    tok = spark.createDataFrame([(byte_level_json,)], "value string").select(F.parse_json("value").alias("v"))
    vocab = vocab_with_bytes(load_vocab(tok), "byte_level")
    rows = {r.token: r for r in vocab.collect()}
    assert rows["Ġ"].decoded == " "
    # Partial UTF-8 bytes decode to U+FFFD and collapse to EF BF BD.
    partial = [r for r in vocab.collect() if r.decoded == "�"]
    assert partial and all(bytes(r.token_bytes) == b"\xef\xbf\xbd" for r in partial)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    m = corpus_token_metrics(docs, vocab).collect()
    assert len(m) == vocab.count()
    the = [r for r in m if r.token == " the"]
    assert the and the[0].freq_in_corpus > 100


def test_byte_level_alphabet_round_trip(spark):
    from tokscope.functions.text import byte_level_to_bytes, to_byte_level

    texts = ["héllo wörld", "根 x\n\t\x00\x7f­ end", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = [bytes(r[0]).decode("utf-8") for r in df.select(byte_level_to_bytes(to_byte_level("t"))).collect()]
    assert back == texts
    assert df.select(to_byte_level(F.lit(" a"))).first()[0] == "Ġa"
