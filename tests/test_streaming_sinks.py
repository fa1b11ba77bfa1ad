"""ST1/ST2 over a split file stream, and K1-K6 round trips."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tokscope.operators.frequency import token_frequency
from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.session import FIXTURE_TOKENIZER
from tokscope.sinks.writers import read_or_compute, write_frequencies, write_merge_closure, write_metrics, write_ranked
from tokscope.sources.tables import METRICS_SCHEMA, load_frequencies, load_metrics
from tokscope.streaming.running import progress_metrics, running_totals, start_running_token_frequency

SF = "/root/testdata/sf0.001"


def test_running_frequency_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    src = str(tmp_path / "src")
    docs.repartition(4).write.parquet(src)
    enc = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = start_running_token_frequency(spark, src, out, ckpt, enc, max_files_per_trigger=1, compact_every=3)
    q.awaitTermination()
    got = {r.token_id: r["count"] for r in running_totals(spark, out).collect()}
    # Batches 0-2 were compacted; the total combines that compaction with batch 3.
    assert spark.read.parquet(f"{out}/totals").select("upto").distinct().collect()[0].upto == 2
    want = {r.token_id: r["count"] for r in token_frequency(docs, enc).collect()}
    assert got == want
    prog = progress_metrics(spark, out).orderBy("batch_id").collect()
    assert len(prog) == 4
    assert sum(r.n_docs for r in prog) == docs.count()
    uniq = [r.unique_tokens for r in prog]
    assert uniq == sorted(uniq) and uniq[-1] == len(want)
    # A restart with nothing new adds no batch and keeps the totals.
    q2 = start_running_token_frequency(spark, src, out, ckpt, enc, max_files_per_trigger=1, compact_every=3)
    q2.awaitTermination()
    assert {r.token_id: r["count"] for r in running_totals(spark, out).collect()} == want


def test_frequency_sinks_round_trip(spark, tmp_path):
    freq = spark.createDataFrame([(1, 5), (7, 9), (3, 5)], "token_id int, count long")
    p = str(tmp_path / "f")
    assert write_frequencies(freq, p, "json_object")
    text = spark.read.text(p).first().value
    assert text == '{"7":9,"1":5,"3":5}'
    assert sorted(tuple(r) for r in load_frequencies(spark, p).collect()) == [(1, 5), (3, 5), (7, 9)]
    empty = freq.filter("false")
    assert write_frequencies(empty, str(tmp_path / "e")) is False


def test_metrics_csv_round_trip(spark, tmp_path):
    import csv
    import glob

    tokens = ['"', "\\", '\\"', 'a"b', "\r", "\r\n", "", "a,b", " x ", "\t", "\n", "a\nb", "é根", '""', "plain"]
    m = spark.createDataFrame([(t, i, 0.5, 1.25, len(t.encode()), i % 2 == 0) for i, t in enumerate(tokens)], METRICS_SCHEMA)
    p = str(tmp_path / "m")
    write_metrics(m, p)
    seen = Observation("seen")
    got = load_metrics(spark, p, seen).collect()
    assert [r.token for r in sorted(got, key=lambda r: r.freq_in_corpus)] == tokens
    assert seen.get == {"malformed": 0, "rows": len(tokens)}
    rows = []
    for part in glob.glob(f"{p}/*.csv"):
        with open(part, newline="", encoding="utf-8") as f:
            rows += list(csv.reader(f))[1:]
    assert {len(r) for r in rows} == {6} and sorted(r[0] for r in rows) == sorted(tokens)


def test_closure_and_ranked_sinks(spark, tmp_path):
    closure = spark.createDataFrame([(0, 2), (0, 3), (1, 2)], "ancestor int, descendant int")
    text = spark.createDataFrame([("a", ["ab", "abc"]), ("b", ["ab"])], "token string, descendants array<string>")
    pi, pt = str(tmp_path / "ids"), str(tmp_path / "txt")
    write_merge_closure(closure, text, pi, pt)
    assert spark.read.text(pi).first().value == '{"0":[2,3],"1":[2]}'
    ranked = spark.createDataFrame([(5, 0.5), (6, -1e8), (7, 1.0)], "token_id int, ratio double")
    pr = str(tmp_path / "r")
    write_ranked(ranked, pr, "ratio", ("token_id",))
    got = [r.token_id for r in spark.read.json(pr).orderBy("rank").collect()]
    assert got == [6, 5, 7]


def test_read_or_compute_reuses(spark, tmp_path):
    p = str(tmp_path / "saved")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3).withColumn("x", F.col("id") * 2)

    assert read_or_compute(spark, p, compute).count() == 3
    assert read_or_compute(spark, p, compute).count() == 3
    assert len(calls) == 1


def test_stream_starts_on_empty_folder(spark, tmp_path):
    src = tmp_path / "empty-src"
    src.mkdir()
    enc = SparkTokenizer(spark, FIXTURE_TOKENIZER)
    out, ckpt = str(tmp_path / "o"), str(tmp_path / "c")
    q = start_running_token_frequency(spark, str(src), out, ckpt, enc, schema="doc_id long, text string")
    q.awaitTermination()
    spark.createDataFrame([(1, "the cat")], "doc_id long, text string").write.mode("append").parquet(str(src))
    q = start_running_token_frequency(spark, str(src), out, ckpt, enc, schema="doc_id long, text string")
    q.awaitTermination()
    assert sum(r["count"] for r in running_totals(spark, out).collect()) > 0


def test_progress_over_many_blocks(spark, tmp_path):
    out = str(tmp_path / "o")
    parts = [(b, t) for b in range(2500) for t in ([b // 5] if b % 5 == 0 else [0])]
    spark.createDataFrame([(t, 1, b) for b, t in parts], "token_id int, count long, batch_id int").write.parquet(f"{out}/partials")
    spark.createDataFrame([(1, b) for b in range(2500)], "n_docs long, batch_id int").write.parquet(f"{out}/progress")
    rows = progress_metrics(spark, out).orderBy("batch_id").collect()
    assert [r.unique_tokens for r in rows] == [b // 5 + 1 for b in range(2500)]
