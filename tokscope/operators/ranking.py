"""Rare-token and survival ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokscope.functions.text import CJK_RANGES, SURVIVAL_SENTINEL, contains_script
from tokscope.operators.ordinal import with_ordinal
from tokscope.session import bounded_broadcast


def zero_fill(vocab: DataFrame, freq: DataFrame) -> DataFrame:
    """Every vocabulary id present with count 0 when unseen; ids outside kept."""
    ids = vocab.select("token_id").distinct()
    return ids.join(freq, "token_id", "full_outer").select(
        "token_id", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("freq")
    )


def descendant_frequency(closure: DataFrame, filled: DataFrame) -> DataFrame:
    """Per token, the summed frequency of all its transitive descendants.

    ``filled`` is ``(token_id, freq)`` from ``zero_fill``. Tokens without
    descendants get 0 (left semantics). One shuffle on the descendant id,
    one on the ancestor; both sides are vocabulary-sized.
    """
    per_anc = (
        closure.join(filled.withColumnRenamed("token_id", "descendant"), "descendant")
        .groupBy("ancestor")
        .agg(F.sum("freq").cast("long").alias("descendant_freq"))
        .withColumnRenamed("ancestor", "token_id")
    )
    return filled.join(per_anc, "token_id", "left").select(
        "token_id", "freq", F.coalesce(F.col("descendant_freq"), F.lit(0)).cast("long").alias("descendant_freq")
    )


def survival_ratio(freq: str = "freq", desc: str = "descendant_freq"):
    """``freq / (freq + descendant_freq)``, sentinel when both are 0."""
    return F.coalesce(F.try_divide(F.col(freq), F.col(freq) + F.col(desc)), F.lit(SURVIVAL_SENTINEL))


def rarest_script_tokens(
    with_desc: DataFrame,
    vocab_decoded: DataFrame,
    ranges: Sequence[tuple[int, int]] = CJK_RANGES,
    vocab_rows: int | None = None,
) -> DataFrame:
    """R2 (+P3/P4, T5): tokens whose decoded text holds a character of
    ``ranges``, as ``(token_id, token, freq, descendant_freq)``; ``ordered_rarest`` ranks them.
    """
    dv = bounded_broadcast(vocab_decoded.select("token_id", F.col("decoded").alias("token")), known_rows=vocab_rows)
    return with_desc.join(dv, "token_id").filter(contains_script("token", ranges)).select(
        "token_id", "token", "freq", "descendant_freq"
    )


def ordered_rarest(rarest: DataFrame) -> DataFrame:
    """R2 in order: ``rank`` (from 0) by ascending frequency, then id; sorted by it."""
    return with_ordinal(rarest, "freq", ["token_id"], "rank").orderBy("rank")


def rank_by_survival_ratio(rarest: DataFrame) -> DataFrame:
    """Adds ``ratio``; order is ascending ratio, then the R2 order."""
    return rarest.withColumn("ratio", survival_ratio())


def ordered_by_ratio(ranked: DataFrame) -> DataFrame:
    """R3 in order: ``rank`` (from 0) by ascending ratio, then frequency, then id; sorted by it."""
    return with_ordinal(ranked, "ratio", ["freq", "token_id"], "rank").orderBy("rank")


def entropy_rank_curve(metrics: DataFrame, value_col: str = "entropy", tie: str = "token_id") -> DataFrame:
    """``(x, y)`` with ``y`` the values sorted descending and ``x`` the 0-based rank.

    ``tie`` (a unique column) only spreads equal values over ranges; equal
    values get consecutive ranks either way.
    """
    vals = metrics.select(F.col(value_col).alias("y"), F.col(tie).alias("_tie"))
    ranked = with_ordinal(vals, "y", ["_tie"], "x", descending=True)
    return ranked.select("x", "y")


def shuffle_rows(df: DataFrame, seed: int = 0) -> DataFrame:
    """A random permutation (``sample(frac=1)``)."""
    return df.orderBy(F.rand(seed))
