"""Running token frequency in Spark's keyed state (ST1), with a progress listener (ST2).

The stream splits texts into pieces and counts them in a stateful aggregate
whose state is keyed by piece and checkpointed with the offsets; in update
mode each micro-batch hands on only the pieces whose total changed. The sink
writes these totals as ``totals/batch_id=N``, encodes only pieces that no
earlier batch had (``encodings/batch_id=N``) and commits with
``progress/batch_id=N``, written last. A batch that was interrupted is run
again from the checkpoint with the same totals and overwrites its folders, so
a restart never counts twice. Totals of a piece only grow: its newest total is
its largest. State and tables are bounded by the distinct pieces, not the
corpus; set the session's RocksDB state store where they outgrow memory.
"""

from __future__ import annotations

from collections import deque

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tokscope.operators.tokenizer import SparkTokenizer, bpe_ids, piece_counts
from tokscope.session import FIXTURE_TOKENIZER, read_table, scratch_path
from tokscope.sources.tables import drop_empty_text

COMPACT_EVERY = 50
#: Name of the stream's observed metrics.
OBSERVED = "documents"
_KEY = ["piece", "is_added"]
_PIECES = "piece string, is_added boolean, n long"


class ProgressListener(StreamingQueryListener):
    """ST2 as it happens: documents, distinct pieces and distinct tokens after each micro-batch.

    Documents come from the stream's observed metrics and pieces from the size
    of its state, both with Spark's progress event; the sink reports the
    distinct tokens of a batch when it commits it. Triggers that read nothing
    leave no row. The newest ``keep`` rows stay on the driver; the sink's
    ``progress`` table keeps all of them.
    """

    def __init__(self, keep: int = 10_000):
        self._rows: deque[dict] = deque(maxlen=keep)
        self._tokens: dict[int, int] = {}
        self.started = self.ended = 0

    def committed(self, batch_id: int, unique_tokens: int) -> None:
        self._tokens[batch_id] = unique_tokens

    @property
    def rows(self) -> list[dict]:
        return list(self._rows)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        self.started += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        if seen is None or p.batchId not in self._tokens:
            return
        pieces = sum(op.numRowsTotal for op in p.stateOperators)
        self._rows.append({"batch_id": p.batchId, "n_docs": seen["n_docs"], "unique_pieces": pieces, "unique_tokens": self._tokens.pop(p.batchId)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended += 1


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that the sink writes batch by batch; empty before the first."""
    try:
        return spark.read.schema(f"{schema}, batch_id int").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch_id int")


def _newest_totals(spark: SparkSession, out_path: str, upto: int) -> DataFrame:
    """``(piece, is_added, n)`` after batch ``upto``: the newest compaction before it and the batches since."""
    compacted = _table(spark, f"{out_path}/compacted", _PIECES).filter(F.col("batch_id") < upto)
    base = compacted.agg(F.max("batch_id")).first()[0]
    base = -1 if base is None else base
    later = _table(spark, f"{out_path}/totals", _PIECES).filter((F.col("batch_id") > base) & (F.col("batch_id") <= upto))
    return compacted.filter(F.col("batch_id") == base).unionByName(later).groupBy(_KEY).agg(F.max("n").alias("n"))


def _last_commit(spark: SparkSession, out_path: str, before: int | None = None) -> tuple[int, int]:
    """Newest committed batch (before ``before``) and the distinct tokens after it; ``(-1, 0)`` without one."""
    rows = _table(spark, f"{out_path}/progress", "unique_tokens long")
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    last = rows.agg(F.max(F.struct("batch_id", "unique_tokens")).alias("x")).first()["x"]
    return (-1, 0) if last is None else (last["batch_id"], last["unique_tokens"])


def _writer(tok: SparkTokenizer, out_path: str, compact_every: int, listener: ProgressListener | None):
    def write_batch(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        totals = f"{out_path}/totals/batch_id={batch_id}"
        changed.write.mode("overwrite").parquet(totals)
        earlier = _table(spark, f"{out_path}/encodings", "piece string, is_added boolean, ids array<int>").filter(F.col("batch_id") < batch_id)
        fresh = spark.read.schema(_PIECES).parquet(totals).join(earlier, _KEY, "left_anti").select(_KEY)
        encodings = f"{out_path}/encodings/batch_id={batch_id}"
        bpe_ids(fresh, tok.spec, tok.merges, tok.vocab).write.mode("overwrite").parquet(encodings)
        # Tokens are vocabulary-sized: those of this batch that no earlier batch had.
        known = _table(spark, f"{out_path}/tokens", "token_id int").filter(F.col("batch_id") < batch_id)
        tokens = spark.read.parquet(encodings).select(F.explode("ids").alias("token_id")).distinct().join(known, "token_id", "left_anti")
        tokens.write.mode("overwrite").parquet(f"{out_path}/tokens/batch_id={batch_id}")
        n_new = spark.read.schema("token_id int").parquet(f"{out_path}/tokens/batch_id={batch_id}").count()
        if compact_every and (batch_id + 1) % compact_every == 0:
            _newest_totals(spark, out_path, batch_id).write.mode("overwrite").parquet(f"{out_path}/compacted/batch_id={batch_id}")
        unique = _last_commit(spark, out_path, batch_id)[1] + n_new
        done = spark.createDataFrame([(unique,)], "unique_tokens long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/progress/batch_id={batch_id}")
        if listener is not None:
            listener.committed(batch_id, unique)

    return write_batch


def start_stateful_token_frequency(
    spark: SparkSession,
    source_dir: str,
    out_path: str,
    checkpoint_path: str,
    tok: SparkTokenizer,
    schema: str,
    text_col: str = "text",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    compact_every: int = COMPACT_EVERY,
    listener: ProgressListener | None = None,
) -> StreamingQuery:
    """Start the stream over the Parquet files that arrive in ``source_dir``.

    ``schema`` is the files' DDL schema. Null and empty texts count nothing.
    Needs a tokenizer whose split and model run in Spark. Add ``listener``
    with ``spark.streams.addListener`` before.
    """
    if not tok.spec.native:
        raise ValueError(f"the stateful count does not cover {tok.spec.reason}")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = drop_empty_text(reader.parquet(source_dir).select(text_col), text_col).observe(OBSERVED, F.count(F.lit(1)).alias("n_docs"))
    writer = piece_counts(docs, tok.spec, text_col).writeStream.outputMode("update")
    writer = writer.foreachBatch(_writer(tok, out_path, compact_every, listener)).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stateful_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """``(token_id, count)`` after the newest committed batch; empty before the first."""
    last, _ = _last_commit(spark, out_path)
    pieces = _newest_totals(spark, out_path, last)
    ids = _table(spark, f"{out_path}/encodings", "piece string, is_added boolean, ids array<int>").filter(F.col("batch_id") <= last)
    rows = pieces.join(ids.select(*_KEY, "ids"), _KEY).select(F.explode("ids").alias("token_id"), "n")
    return rows.groupBy("token_id").agg(F.sum("n").cast("long").alias("count"))


#: Parts that the registered form feeds one after the other, each to a restarted stream.
REGISTERED_PARTS = 3


def stateful_token_frequency_table(spark: SparkSession, sf_dir: str, tokenizer_path: str = FIXTURE_TOKENIZER) -> DataFrame:
    """Registered form: all ``documents`` arrive in parts (by id), the stream is started again for each."""
    arrivals, out, ckpt = (scratch_path(spark, f"stateful-{x}") for x in ("in", "out", "checkpoint"))
    tok = SparkTokenizer(spark, tokenizer_path)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    for part in range(REGISTERED_PARTS):
        docs.filter(F.pmod(F.hash("doc_id"), F.lit(REGISTERED_PARTS)) == part).write.mode("append").parquet(arrivals)
        start_stateful_token_frequency(spark, arrivals, out, ckpt, tok, "doc_id long, text string", compact_every=2).awaitTermination()
    return stateful_totals(spark, out)
