"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokscope.llm.common import written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest reachable node.

    Each round points the larger neighbours of every node (large star), then
    the smaller ones (small star), at the smallest node around it. Rounds are
    logarithmic in the longest path; a hub only ever contributes a minimum,
    which is aggregated before the shuffle.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, name)
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = written(small.filter("u <> v").distinct(), name)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000000007"))).first()
        if now == before:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")
