"""Result sinks.

Tables are written as parquet/JSON/CSV by executors; nothing is collected
to the driver. The single-object JSON export of K1/K3 builds one row whose
size is bounded by the vocabulary (ids and counts), never by the corpus.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.operators.ordinal import with_ordinal

log = logging.getLogger(__name__)


def _written_empty(spark: SparkSession, path: str, fmt: str, what: str) -> bool:
    """After writing, warn when the output holds no rows.

    The check reads the files just written (cheap) instead of running the
    producing plan a second time.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if fmt == "text":
        empty = reader.load(path).filter(F.col("value") != "{}").isEmpty()
    else:
        empty = reader.load(path).isEmpty()
    if empty:
        log.warning("no %s were produced (is the corpus empty or the path wrong?)", what)
    return empty


def write_frequencies(freq: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """K1: ``(token_id, count)`` by count descending, id ascending on ties.

    ``fmt='parquet'|'json'`` writes one row per token (range-partitioned
    sort, so part files are in order); ``fmt='json_object'`` writes the
    single ``{"<id>": count, …}`` object, entries in sorted order (one row
    whose size is bounded by the vocabulary). Returns ``False`` (and warns)
    when there were no tokens.
    """
    spark = freq.sparkSession
    if fmt == "json_object":
        entries = F.array_sort(
            F.collect_list(F.struct((-F.col("count")).alias("k"), F.col("token_id").alias("i"), F.col("count").alias("c")))
        )
        obj = freq.agg(
            F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["i"].cast("string"), e["c"])))).alias(
                "value"
            )
        )
        obj.coalesce(1).write.mode("overwrite").text(path)
        return not _written_empty(spark, path, "text", "token counts")
    freq.orderBy(F.desc("count"), F.asc("token_id")).write.mode("overwrite").format(fmt).save(path)
    return not _written_empty(spark, path, fmt, "token counts")


def write_metrics(metrics: DataFrame, path: str) -> bool:
    """K2: metrics CSV, frequency descending, header, no index column.

    Quotes are doubled, so any CSV reader gets the tokens back, whatever they
    hold. Spark's CSV writer adds no UTF-8 byte-order mark (the analysed
    program writes one); readers that need it can prepend it.
    """
    cols = ["token", "freq_in_corpus", "standalone_ratio", "entropy", "length_bytes", "meaningless"]
    (
        metrics.orderBy(F.desc("freq_in_corpus"), F.asc("token"))
        .select(*cols)
        .write.mode("overwrite")
        .option("header", True)
        # Tokens may be spaces, tabs or newlines: keep them, quote everything.
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
    return not _written_empty(metrics.sparkSession, path, "csv", "metrics")


def write_merge_closure(closure: DataFrame, closure_text: DataFrame, path_ids: str, path_text: str) -> bool:
    """K3: ``{id: [ids…]}`` and ``{decoded: [decoded…]}`` as single JSON objects.

    One map entry per ancestor; the map is vocabulary-sized.
    """
    adj = closure.groupBy("ancestor").agg(F.array_sort(F.collect_set("descendant")).alias("d"))
    ids = adj.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("ancestor").cast("string"), "d"))))).alias(
            "value"
        )
    )
    ids.coalesce(1).write.mode("overwrite").text(path_ids)
    txt = closure_text.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "descendants")))).alias("value")
    )
    txt.coalesce(1).write.mode("overwrite").text(path_text)
    return not _written_empty(closure.sparkSession, path_ids, "text", "merge closure pairs")


def write_ranked(ranked: DataFrame, path: str, key: str, ties: tuple[str, ...] = ()) -> bool:
    """K4: rows by ``key`` then ``ties`` with an explicit ``rank`` column (order survives partitions)."""
    with_ordinal(ranked, key, ties, "rank").orderBy("rank").write.mode("overwrite").json(path)
    return not _written_empty(ranked.sparkSession, path, "json", "ranked tokens")


def read_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """K6: reuse a saved table when present, else compute, save and reuse it."""
    if not committed(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` finished (its ``_SUCCESS`` marker exists)."""
    try:
        spark.read.text(f"{path.rstrip('/')}/_SUCCESS").limit(1).collect()
        return True
    except AnalysisException:
        return False

