"""Dense global row numbers without a single-partition window.

``row_number() OVER (ORDER BY …)`` with no partition clause moves every
row into one task. Instead rows are put into ordered buckets by a
deterministic function of the sort key (quantile split points computed
once, then ``Bucketizer``'s binary search), each bucket is numbered
locally, and a per-bucket offset (one row per bucket, a tiny table) is
added back. Because the bucket of a row depends only on its key and the
fixed split points, the per-bucket counts and the local numbers agree even
when they are computed by different stages or after a task is retried
(a sampled range partitioning would be re-sampled per exchange).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def split_points(df: DataFrame, key: str, buckets: int) -> list[float]:
    """Strictly increasing split points for ``buckets`` ordered buckets of ``key``.

    ``approxQuantile`` runs one job and returns at most ``buckets - 1``
    values to the driver (a bound independent of the data size). Its error is
    a quarter of a bucket, so that many buckets are really told apart.
    """
    rel_error = 1 / (4 * max(buckets, 1))
    probs = [i / buckets for i in range(1, buckets)]
    qs = df.approxQuantile(key, probs, rel_error) if probs else []
    inner = sorted({float(q) for q in qs if math.isfinite(q)})
    # Bucketizer needs at least one inner split (empty input, or one distinct value).
    return [float("-inf"), *(inner or [0.0]), float("inf")]


def with_ordinal(
    df: DataFrame,
    key: str,
    ties: Sequence[str] = (),
    name: str = "ordinal",
    descending: bool = False,
    partitions: int | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add a 0-based ``name`` following numeric ``key`` (then ``ties``, ascending).

    ``descending`` orders by ``key`` from high to low. Give unique ``ties``
    when equal keys must be numbered repeatably. All rows with one key value
    share a bucket, so a key value holding a large share of the rows makes
    one large bucket (still correct; the uses here sort unique ids or
    vocabulary-sized tables). With ``keep_bucket`` the bucket ``_b``, the
    ordinal of its first row ``_off`` and its number of rows ``_n`` are kept; the rows
    are partitioned by ``_b``.
    """
    k = F.col(key).cast("double")
    keyed = df.withColumn("_k", -k if descending else k)
    splits = split_points(keyed, "_k", _parts(df, partitions))
    bucketed = Bucketizer(splits=splits, inputCol="_k", outputCol="_b", handleInvalid="keep").transform(keyed)
    # NaN keys get bucket len(splits) - 1 from ``keep``; NULL keys get the one after it (nulls last).
    bucketed = bucketed.withColumn("_b", F.coalesce(F.col("_b"), F.lit(float(len(splits)))).cast("int"))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    order = [F.col("_k").asc_nulls_last(), F.col(key).desc() if descending else F.col(key).asc()]
    order += [F.col(t).asc() for t in ties]
    local = bucketed.withColumn("_local", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    # ``offsets`` has one row per bucket (at most ``partitions`` + 1 rows).
    out = local.join(F.broadcast(offsets), "_b").withColumn(name, (F.col("_off") + F.col("_local") - 1).cast("long"))
    return out.drop("_k", "_local") if keep_bucket else out.drop("_k", "_b", "_off", "_n", "_local")
