"""Running token frequency over a file stream (ST1) and its progress (ST2).

Each micro-batch is counted with the batch operator (distinct pre-tokens
encoded once) and written as its own partial table ``batch_id=N``,
overwritten if the batch is replayed, so a restart after a lost executor
or driver never counts a batch twice. Every ``compact_every`` batches the
totals so far are written as ``totals/upto=N``; the running total is the
newest compaction plus the partials after it. State lives in the shared
sink folder and is bounded by the vocabulary. Partial results survive an
interrupt, as in the analysed program.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tokscope.operators.frequency import token_frequency
from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.session import FIXTURE_TOKENIZER, read_table, scratch_path
from tokscope.sources.tables import drop_empty_text


COMPACT_EVERY = 50


def _partials(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(f"{out_path}/partials")


def _latest_compaction(spark: SparkSession, out_path: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """Newest compacted totals (strictly before ``before``) and the batch id they cover."""
    try:
        marks = spark.read.parquet(f"{out_path}/totals").select("upto").distinct()
    except AnalysisException:
        return None, -1
    if before is not None:
        marks = marks.filter(F.col("upto") < before)
    upto = marks.agg(F.max("upto")).first()[0]
    if upto is None:
        return None, -1
    totals = spark.read.parquet(f"{out_path}/totals").filter(F.col("upto") == upto).select("token_id", "count")
    return totals, int(upto)


def _totals_upto(spark: SparkSession, out_path: str, last_batch: int | None = None) -> DataFrame:
    """Running totals: newest compaction plus the partials written after it."""
    base, upto = _latest_compaction(spark, out_path, None if last_batch is None else last_batch)
    parts = _partials(spark, out_path).filter(F.col("batch_id") > upto)
    if last_batch is not None:
        parts = parts.filter(F.col("batch_id") <= last_batch)
    rows = parts.select("token_id", "count")
    if base is not None:
        rows = rows.unionByName(base)
    return rows.groupBy("token_id").agg(F.sum("count").cast("long").alias("count"))


def _writer(tok: SparkTokenizer, out_path: str, text_col: str, compact_every: int):
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # One pass: documents are counted while they are split.
        seen = Observation(f"documents_{batch_id}")
        docs = drop_empty_text(batch.select(text_col), text_col).observe(seen, F.count(F.lit(1)).alias("n_docs"))
        token_frequency(docs, tok, text_col).write.mode("overwrite").parquet(f"{out_path}/partials/batch_id={batch_id}")
        progress = spark.createDataFrame([(int(seen.get["n_docs"]),)], "n_docs long")
        progress.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/progress/batch_id={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            # Deterministic in batch_id, so a replayed batch rewrites the same totals.
            totals = _totals_upto(spark, out_path, batch_id)
            totals.write.mode("overwrite").parquet(f"{out_path}/totals/upto={batch_id}")

    return write_batch


def start_running_token_frequency(
    spark: SparkSession,
    source_dir: str,
    out_path: str,
    checkpoint_path: str,
    tok: SparkTokenizer,
    file_glob: str = "*.parquet",
    text_col: str = "text",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    compact_every: int = COMPACT_EVERY,
    schema: str | None = None,
):
    """Start the stream; returns the ``StreamingQuery``.

    Every ``compact_every`` batches the running totals are also written as
    ``totals/upto=N``, so reading the totals never scans more than that many
    per-batch partials (state stays bounded by the vocabulary). Give
    ``schema`` (DDL) when the source folder may still be empty.
    """
    if schema is None:
        schema = spark.read.parquet(f"{source_dir.rstrip('/')}/{file_glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir).select(text_col)
    writer = stream.writeStream.foreachBatch(_writer(tok, out_path, text_col, compact_every)).option(
        "checkpointLocation", checkpoint_path
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def running_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """ST1 result: ``(token_id, count)`` over all batches written so far."""
    return _totals_upto(spark, out_path)


#: Batches summed in one window task by ``progress_metrics``.
_PROGRESS_BLOCK = 1000


def progress_metrics(spark: SparkSession, out_path: str) -> DataFrame:
    """ST2: per batch, documents read and distinct tokens seen so far.

    ``(batch_id, n_docs, unique_tokens)``; one row per micro-batch. The running
    sum is taken within blocks of batches, and one row per block is added up across them.
    """
    docs = spark.read.parquet(f"{out_path}/progress").groupBy("batch_id").agg(F.sum("n_docs").alias("n_docs"))
    first = _partials(spark, out_path).groupBy("token_id").agg(F.min("batch_id").alias("batch_id"))
    fresh = first.groupBy("batch_id").agg(F.count(F.lit(1)).alias("fresh"))
    rows = docs.join(fresh, "batch_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    rows = rows.withColumn("block", F.floor(F.col("batch_id") / _PROGRESS_BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("block").agg(F.sum("fresh").alias("total")).select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("fresh").over(within)).join(bases, "block")
    return summed.select("batch_id", "n_docs", (F.col("base") + F.col("upto")).cast("long").alias("unique_tokens"))


#: Parts the registered forms feed one after the other, each its own micro-batch.
REGISTERED_PARTS = 4


def _fed_in_parts(spark: SparkSession, sf_dir: str, tokenizer_path: str) -> str:
    """Feed ``documents`` to a restarted stream part by part (by id modulo); returns the sink folder.

    Every start reads what has arrived since, as one micro-batch, and goes on
    from the checkpoint.
    """
    arrivals, out, ckpt = (scratch_path(spark, f"running-{x}") for x in ("in", "out", "checkpoint"))
    tok = SparkTokenizer(spark, tokenizer_path)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    for part in range(REGISTERED_PARTS):
        docs.filter(F.pmod("doc_id", F.lit(REGISTERED_PARTS)) == part).write.mode("append").parquet(arrivals)
        start_running_token_frequency(spark, arrivals, out, ckpt, tok, compact_every=3).awaitTermination()
    return out


def running_token_frequency_table(spark: SparkSession, sf_dir: str, tokenizer_path: str = FIXTURE_TOKENIZER) -> DataFrame:
    """Registered form: stream ``documents`` in several batches to completion, return the totals."""
    return running_totals(spark, _fed_in_parts(spark, sf_dir, tokenizer_path))


def running_progress_table(spark: SparkSession, sf_dir: str, tokenizer_path: str = FIXTURE_TOKENIZER) -> DataFrame:
    """Registered form of ST2: stream ``documents`` in several batches, return per-batch progress."""
    return progress_metrics(spark, _fed_in_parts(spark, sf_dir, tokenizer_path))
