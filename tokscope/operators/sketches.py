"""Mergeable summaries of token rows: distinct counts (A2) and heavy hitters.

One summary per batch, file or source is kept as a row; the figures of any
union come from the summaries without reading the rows again. A distinct
count is approximate with a known error; ``top_k_verified`` is exact: the
summaries only propose candidates, their rows are counted, and the result is
returned once no other item can reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokscope.operators.frequency import top_k

#: log2 of the sketch's registers: relative standard error 1.04 / sqrt(2 ** 14), about 0.8 %.
LG_REGISTERS = 14
#: Items that a heavy-hitter summary follows, first try.
TRACKED = 4096
#: More are not tried (Spark's own limit is a million); then all items are counted.
MAX_TRACKED = 262_144


def relative_error(lg_registers: int = LG_REGISTERS) -> float:
    """Standard error of a distinct sketch as a share of the count."""
    return 1.04 / 2 ** (lg_registers / 2)


def distinct_sketches(rows: DataFrame, key: str, by: list[str], lg_registers: int = LG_REGISTERS) -> DataFrame:
    """One row per group ``by`` with ``sketch`` of its distinct ``key`` values (nulls are not counted)."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(key), lg_registers).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct values of the union of sketches, per group ``by`` or of all: ``n_distinct long``."""
    n = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*(by or [])).agg(F.coalesce(n, F.lit(0)).cast("long").alias("n_distinct"))


def heavy_summaries(rows: DataFrame, key: str, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """One row per group ``by``: ``state`` following the ``tracked`` most frequent ``key`` values, and ``n`` rows with one."""
    known = rows.filter(F.col(key).isNotNull()).withColumnRenamed(key, "_item")
    return known.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(_item, {tracked})").alias("state"), F.count(F.lit(1)).alias("n"))


def _candidates(summaries: DataFrame, tracked: int, want: int) -> tuple[list[tuple], int]:
    """Up to ``want`` most frequent items ``(item, estimate)`` of the union, and its number of rows."""
    both = summaries.agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"), F.sum("n").alias("n"))
    row = both.select(F.expr(f"approx_top_k_estimate(state, {want})").alias("top"), "n").first()
    return [tuple(x) for x in row["top"] or []], row["n"] or 0


def top_k_verified(rows: DataFrame, key: str, k: int = 20, by: list[str] | None = None, tracked: int = TRACKED, max_tracked: int = MAX_TRACKED, tries: list | None = None) -> DataFrame:
    """The exact ``k`` most frequent values: ``(key, count)``, ties by ascending key.

    A summary over ``n`` rows misses at most ``3.5 * n / size`` occurrences of any
    item, where ``size`` is its table (at least ``tracked``), and lists only items
    seen more often than that, so one not listed has at most twice as many. The ``8 * k`` best
    candidates are counted exactly; if the k-th count is above that bound and
    above the estimates of all items that were no candidates, nothing else can
    belong to the result. Otherwise it tries again with eight times as many
    items, and beyond ``max_tracked`` counts all of them. ``tries`` collects
    the sizes used (None: all counted). Nulls take no part.
    """
    while tracked <= max_tracked:
        if tries is not None:
            tries.append(tracked)
        found, n = _candidates(heavy_summaries(rows, key, by or [], tracked), tracked, 8 * k)
        if not n:
            break
        # At most 8 k literals.
        counted = rows.filter(F.col(key).isin([x[0] for x in found]) if found else F.lit(False)).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
        result = top_k(counted, k, key=key)
        least = [r["count"] for r in result.select("count").collect()]
        # Estimates are upper bounds, so an item left out of a full list has at most the last one.
        bound = max(7.0 * n / tracked, found[-1][1] if len(found) == 8 * k else 0)
        if len(least) == k and min(least) > bound:
            return result
        tracked *= 8
    if tries is not None:
        tries.append(None)
    return top_k(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count")), k, key=key)


def within_error(estimate: Column, exact: Column, sigmas: float = 5.0, lg_registers: int = LG_REGISTERS) -> Column:
    """Whether an estimate lies within ``sigmas`` standard errors of the exact count."""
    return F.abs(estimate - exact) <= sigmas * relative_error(lg_registers) * exact
