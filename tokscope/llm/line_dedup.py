"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

``LineRuns`` is a small log-structured index in a shared folder. Level 0
holds one run per added batch; when a level has ``fanout`` runs they are
merged into one run of the next level, so an index of ``b`` batches has at
most ``fanout * log(b)`` runs. A run is a Parquet table sorted by the 128-bit
line hash with one row per hash: the number of documents that hold the line
and the largest of their ids. A new batch is merge-anti-joined with the runs
(its hashes that no run has yet are *fresh*), the others are kept as an
increment, and both are added as the batch's own run.

Text is never shuffled by line: hashes travel, and a document's text moves
once, by its id, when lines are dropped from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.llm.common import ascii_lower, compact, ensure_checkpoint_dir, scratch_path, strip_spaces, written

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(strip_spaces(line))


def line_hashes(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points.

    Columns: ``doc_id``, ``row_hash`` (tells rows with one id and different
    texts apart), ``line_no``, ``h1``, ``h2``, ``batch``.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_hash"), F.split("text", "\n").alias("lines"))
    lines = rows.select("doc_id", "row_hash", F.posexplode("lines").alias("line_no", "line"))
    # A key is never longer than its line, so short lines need no key.
    keys = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    batch = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(batches)).cast("int")
    return keys.select("doc_id", "row_hash", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), batch.alias("batch"))


def _run(lines: DataFrame) -> DataFrame:
    """Run of one batch: documents per hash and the largest id (a row is a document)."""
    per_row = lines.groupBy(*HASH, "doc_id", "row_hash").agg(F.lit(1).alias("one"))
    return per_row.groupBy(*HASH).agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("max_doc"))


class LineRuns:
    """Levelled sorted runs under ``root`` (a shared folder)."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 3):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        ensure_checkpoint_dir(spark)
        self.spark, self.root, self.fanout = spark, root or scratch_path(spark, "line-runs"), fanout
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _write(self, run: DataFrame, level: int) -> str:
        self._made += 1
        path = f"{self.root}/level{level}/run{self._made:05d}"
        compact(run.select(*HASH, "n_docs", "max_doc", "fresh")).sortWithinPartitions(*HASH).write.parquet(path)
        return path

    def runs(self) -> DataFrame | None:
        """All rows of all runs (a hash may stand in several), or None while there are none."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of :func:`line_hashes`; returns the hashes no earlier batch had."""
        own = _run(lines)
        old = self.runs()
        if old is None:
            run = own.withColumn("fresh", F.lit(True))
        else:
            own = written(own, "line-batch")
            known = old.select(*HASH).hint("merge")
            fresh = own.join(known, HASH, "left_anti").withColumn("fresh", F.lit(True))
            run = fresh.unionByName(own.join(known, HASH, "left_semi").withColumn("fresh", F.lit(False)))
        path = self._write(run, 0)
        self.levels[0].append(path)
        self._compact()
        return self.spark.read.parquet(path).filter("fresh").select(*HASH)

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.spark.read.parquet(*self.levels[level]).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.bool_or("fresh").alias("fresh"))
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged, level + 1))
            self.levels[level] = []
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Hashes found in at least ``min_docs`` documents: ``h1, h2, max_doc``."""
        total = self.runs().groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return total.filter(F.col("n_docs") >= min_docs).select(*HASH, "max_doc")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop lines that many documents share, except in the largest ``doc_id`` holding them.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their
    names, pass through unchanged (``text`` is replaced by the kept text). Adds
    ``n_lines`` (before dropping) and ``n_dropped``; columns of those names are
    replaced.

    Edge cases: a null or empty text is one empty line and stays (null becomes
    ''). Every row counts as a document: rows repeated under one id count each,
    and all rows with the largest id keep their line. Null ids are
    smaller than all others; where all holders have null ids, all keep the line. A
    document may lose all its lines; its text is then ''. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    lines = written(line_hashes(docs, min_chars, batches), "line-hashes")
    index = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        index.add(lines.filter(F.col("batch") == b))
    frequent = index.frequent(min_docs)
    hit = lines.join(frequent, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    drops = hit.groupBy("doc_id", "row_hash").agg(F.collect_set("line_no").alias("__llm_drop"))
    drops = drops.select(F.col("doc_id").alias("__llm_id"), F.col("row_hash").alias("__llm_rh"), "__llm_drop")
    out = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    base = docs.select(*[F.col(f"`{c}`") for c in out]).withColumn("text", F.coalesce("text", F.lit("")))
    joined = base.join(drops, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.xxhash64("text") == F.col("__llm_rh")), "left")
    joined = joined.withColumn("__llm_lines", F.split("text", "\n"))
    kept = F.expr("array_join(filter(__llm_lines, (x, i) -> not array_contains(__llm_drop, i)), '\n')")
    text = F.when(F.col("__llm_drop").isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in out],
        F.size("__llm_lines").cast("long").alias("n_lines"),
        F.when(F.col("__llm_drop").isNull(), F.lit(0)).otherwise(F.size("__llm_drop")).cast("long").alias("n_dropped"),
    )
