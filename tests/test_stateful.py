"""Keyed-state running count: equal to the batch count, also after an interrupt; listener against the tables."""

import time

import pytest
from pyspark.sql import functions as F

from tokscope.operators.frequency import token_frequency
from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.session import FIXTURE_TOKENIZER
from tokscope.streaming import stateful
from tokscope.streaming.running import progress_metrics, start_running_token_frequency

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def counts(df):
    return {r.token_id: r["count"] for r in df.collect()}


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    src = str(tmp_path_factory.mktemp("arrived") / "src")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "the the")], SCHEMA)
    docs.unionByName(odd).repartition(4).write.parquet(src)
    return src, counts(token_frequency(spark.read.parquet(src).filter(F.length("text") > 0), SparkTokenizer(spark, FIXTURE_TOKENIZER)))


def test_interrupted_stream_ends_with_the_batch_count(spark, tmp_path, arrived, monkeypatch):
    src, want = arrived
    tok = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    assert counts(stateful.stateful_totals(spark, out)) == {}

    def start():
        return stateful.start_stateful_token_frequency(spark, src, out, ckpt, tok, SCHEMA, max_files_per_trigger=1, compact_every=2)

    real = stateful.bpe_ids
    calls = []

    def failing(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("interrupted")
        return real(*args)

    # The third batch fails after its totals were written: they must not count yet.
    monkeypatch.setattr(stateful, "bpe_ids", failing)
    with pytest.raises(Exception, match="interrupted"):
        start().awaitTermination()
    assert stateful._last_commit(spark, out)[0] == 1
    part = counts(stateful.stateful_totals(spark, out))
    assert 0 < sum(part.values()) < sum(want.values())
    start().awaitTermination()
    assert counts(stateful.stateful_totals(spark, out)) == want
    assert stateful._last_commit(spark, out) == (3, len(want))
    # A restart without new files changes nothing.
    start().awaitTermination()
    assert counts(stateful.stateful_totals(spark, out)) == want
    # Every piece was encoded once.
    enc = spark.read.parquet(f"{out}/encodings")
    assert enc.count() == enc.select("piece", "is_added").distinct().count()


def test_listener_agrees_with_progress_metrics(spark, tmp_path, arrived):
    src, want = arrived
    tok = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    listener = stateful.ProgressListener()
    spark.streams.addListener(listener)
    try:
        out = str(tmp_path / "out")
        stateful.start_stateful_token_frequency(spark, src, out, str(tmp_path / "c"), tok, SCHEMA, max_files_per_trigger=1, listener=listener).awaitTermination()
        for _ in range(100):
            if len(listener.rows) == 4 and listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    other = str(tmp_path / "other")
    start_running_token_frequency(spark, src, other, str(tmp_path / "c2"), tok, max_files_per_trigger=1, schema=SCHEMA).awaitTermination()
    rows = [tuple(r) for r in progress_metrics(spark, other).orderBy("batch_id").collect()]
    assert [(r["batch_id"], r["n_docs"], r["unique_tokens"]) for r in listener.rows] == rows
    assert listener.started == 1 and listener.rows[-1]["unique_tokens"] == len(want)
    assert listener.rows[-1]["unique_pieces"] == spark.read.parquet(f"{out}/encodings").count()
