"""Vocabulary sources (S6): ``tokenizer.json`` to ``vocab`` and ``merges`` tables.

The file is config-sized (bounded by the vocabulary, never by the
corpus). It is read as one whole-text row, parsed as a VARIANT, and
exploded into rows; everything after that is ordinary DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.functions.text import byte_level_to_bytes, replace_invalid, utf8_bytes


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """One row holding the parsed tokenizer file as ``v VARIANT``."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))


def load_vocab(tok: DataFrame) -> DataFrame:
    """``vocab(token_id int, token string, special boolean, score double)``.

    ``model.vocab`` plus ``added_tokens`` (the latter win on an id clash,
    as the tokenizer library does). ``score`` is that of a scored list
    (Unigram), whose ids are its places; null in other files.
    """
    by_name = tok.select(F.explode(F.try_variant_get("v", "$.model.vocab", "map<string,int>")).alias("token", "token_id"))
    listed = tok.select(F.posexplode(F.try_variant_get("v", "$.model.vocab", "array<variant>")).alias("token_id", "x"))
    scored = listed.select("token_id", F.variant_get("x", "$[0]", "string").alias("token"), F.variant_get("x", "$[1]", "double").alias("score"))
    base = by_name.withColumn("score", F.lit(None).cast("double")).unionByName(scored).select("token_id", "token", F.lit(False).alias("special"), "score")
    added = tok.select(
        F.explode(F.variant_get("v", "$.added_tokens", "array<struct<id:int,content:string,special:boolean>>")).alias(
            "a"
        )
    ).select(
        F.col("a.id").alias("token_id"),
        F.col("a.content").alias("token"),
        F.coalesce(F.col("a.special"), F.lit(True)).alias("special"),
        F.lit(None).cast("double").alias("score"),
    )
    kept_base = base.join(added.select("token_id"), "token_id", "left_anti")
    return kept_base.unionByName(added)


def load_merges(tok: DataFrame) -> DataFrame:
    """``merges(rank int, left string, right string)``, rank from 1.

    Accepts both file forms: a pair ``["a","b"]`` and the older string
    ``"a b"`` (split at the first space).
    """
    items = tok.select(F.posexplode(F.variant_get("v", "$.model.merges", "array<variant>")).alias("pos", "m"))
    is_pair = F.schema_of_variant("m").startswith("ARRAY")
    as_str = F.try_variant_get("m", "$", "string")
    left = F.when(is_pair, F.variant_get("m", "$[0]", "string")).otherwise(F.split(as_str, " ", 2).getItem(0))
    right = F.when(is_pair, F.variant_get("m", "$[1]", "string")).otherwise(F.split(as_str, " ", 2).getItem(1))
    return items.select((F.col("pos") + 1).cast("int").alias("rank"), left.alias("left"), right.alias("right"))


def vocab_with_bytes(vocab: DataFrame, mode: str = "text") -> DataFrame:
    """P5: add ``token_bytes`` and ``decoded`` to a vocab table.

    ``mode='text'``: the token string is the text (character-level BPE).
    ``mode='byte_level'``: the token string spells bytes in the byte-level
    alphabet; bytes are recovered and ``decoded`` replaces invalid UTF-8
    with U+FFFD, so partial-byte tokens all decode to ``"\\ufffd"`` and
    their ``token_bytes`` become ``EF BF BD`` as in the analysed program.
    ``mode='byte_level_raw'``: as ``byte_level`` but ``token_bytes`` are
    the token's own bytes, partial UTF-8 sequences kept. Special tokens are
    always taken as text.
    """
    if mode == "text":
        raw = utf8_bytes("token")
    elif mode in ("byte_level", "byte_level_raw"):
        raw = F.when(F.col("special"), utf8_bytes("token")).otherwise(byte_level_to_bytes("token"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    with_raw = vocab.withColumn("raw_bytes", raw)
    decoded = replace_invalid("raw_bytes")
    out = with_raw.withColumn("decoded", decoded)
    if mode == "byte_level_raw":
        # The token's own bytes, partial UTF-8 kept (no U+FFFD collapse).
        return out.withColumn("token_bytes", F.col("raw_bytes"))
    return out.withColumn("token_bytes", utf8_bytes("decoded"))
