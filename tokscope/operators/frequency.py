"""Token frequency aggregations (A1, A2) and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tokscope.operators.encode import encode_column
from tokscope.operators.tokenizer import SparkTokenizer, bpe_frequency, piece_counts


def token_frequency(docs: DataFrame, tok: SparkTokenizer, text_col: str = "text", observation: Observation | None = None, add_special_tokens: bool = False) -> DataFrame:
    """A1 over a corpus: ``(token_id, count)``, exact for every tokenizer.

    Where the tokenizer's split and model run in Spark (``tok.spec.native``):
    ``scan -> explode(pieces) -> groupBy(piece) -> entries by join -> explode ->
    groupBy(token_id)``; a piece or token holding a third of all rows costs one
    row per task in the shuffles. Otherwise every row is encoded whole by the
    library plug-in; ``observation`` then counts the rows it failed on. With
    ``add_special_tokens`` each text that is not null also counts the ids of the post-processor's template.
    """
    if not tok.spec.native:
        return token_frequency_whole_text(docs, tok.library_encoder(add_special_tokens), text_col, observation)
    freq = bpe_frequency(piece_counts(docs, tok.spec, text_col), tok.spec, tok.merges, tok.vocab)
    around = [*tok.spec.before, *tok.spec.after] if add_special_tokens else []
    if not around:
        return freq
    texts = docs.agg(F.count(text_col).alias("n"))
    extra = texts.select(F.explode(F.array(*map(F.lit, around))).alias("token_id"), F.col("n").alias("count"))
    return freq.unionByName(extra).groupBy("token_id").agg(F.sum("count").alias("count")).filter("count > 0")


def token_frequency_whole_text(docs: DataFrame, encoder, text_col: str = "text", observation: Observation | None = None) -> DataFrame:
    """A1 by encoding each row whole (T1) with a plug-in; failed rows are counted by ``observation``."""
    encoded = encode_column(docs.select(text_col), encoder, text_col, observation)
    return encoded.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("count"))


def distinct_token_count(freq: DataFrame, key: str = "token_id", approx: bool = False) -> DataFrame:
    """A2: number of distinct tokens; exact, or HyperLogLog++ with ``approx``.

    On a ``(token_id, count)`` table the keys are already unique, so the
    exact form is a plain count; on raw token rows it de-duplicates.
    """
    n = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return freq.agg(n.alias("n_distinct"))


def top_k(freq: DataFrame, k: int = 20, count_col: str = "count", key: str = "token_id") -> DataFrame:
    """First ``k`` by count descending, key ascending on ties.

    ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps k
    rows, the driver merges k x tasks rows.
    """
    return freq.orderBy(F.desc(count_col), F.asc(key)).limit(k)


def sort_by_frequency_desc(freq: DataFrame, count_col: str = "count", key: str = "token_id") -> DataFrame:
    """Count descending with an explicit tie-break (range-partitioned sort)."""
    return freq.orderBy(F.desc(count_col), F.asc(key))
