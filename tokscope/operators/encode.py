"""Encoder plug-ins over rows (T1, T2) and decoding (T5).

Counting and encoding run without a library (``tokenizer.py``). The plug-ins
here are for tokenizers that Spark cannot reproduce exactly, for other
encoders (T2), and for cross-checks; they run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokscope.session import bounded_broadcast, ship_package

#: Characters handed to an encoder at once, so a batch of long texts stays bounded (a longer text goes alone).
ENCODE_CHARS = 4_000_000


# -- encoder plug-ins (UDF surface, 2.12) ------------------------------------


class HFTokenizerEncoder:
    """Picklable factory for a ``tokenizers`` encoder built from JSON text.

    With a session the JSON is shipped once per executor as a broadcast
    variable (a production vocabulary file is several MB; a closure would
    carry it in every task); without one it rides in the closure. The
    encoder is built once per Python worker and reused across batches.
    """

    def __init__(self, tokenizer_json, add_special_tokens: bool = False):
        self.tokenizer_json = tokenizer_json  # str or Broadcast[str]
        self.add_special_tokens = add_special_tokens
        self._tok = None

    def __getstate__(self):
        return {"tokenizer_json": self.tokenizer_json, "add_special_tokens": self.add_special_tokens, "_tok": None}

    def _get(self):
        if self._tok is None:
            from tokenizers import Tokenizer

            src = self.tokenizer_json
            self._tok = Tokenizer.from_str(src if isinstance(src, str) else src.value)
        return self._tok

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        encs = self._get().encode_batch(texts, add_special_tokens=self.add_special_tokens)
        return [e.ids for e in encs]

    @classmethod
    def from_text(cls, text: str, add_special_tokens: bool = False, spark: SparkSession | None = None) -> HFTokenizerEncoder:
        if spark is not None:
            try:
                return cls(spark.sparkContext.broadcast(text), add_special_tokens)
            except Exception:  # noqa: BLE001 - no broadcast variables (Spark Connect)
                pass
        return cls(text, add_special_tokens)


class TiktokenEncoder:
    """T2 plug-in: a ``tiktoken`` encoding, when its files are available locally.

    Failed rows are reported as NULL (counted by callers), never as ``[]``.
    """

    def __init__(self, name: str = "cl100k_base"):
        self.name = name
        self._enc = None

    def _get(self):
        if self._enc is None:
            import tiktoken

            self._enc = tiktoken.get_encoding(self.name)
        return self._enc

    def encode_batch(self, texts: list[str]) -> list[list[int] | None]:
        enc = self._get()
        out: list[list[int] | None] = []
        for t in texts:
            try:
                out.append(enc.encode_ordinary(t))
            except Exception:  # noqa: BLE001 - a bad row must not end the task
                out.append(None)
        return out


# -- encoder over rows (T1/T2) ---------------------------------------------------


def _encode_frames(encoder, text_col: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def parts(texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > ENCODE_CHARS:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t)
        if part:
            yield part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].tolist()
            # A batch may repeat a text (streaming, short rows): encode each once.
            encoded: dict = {None: None}
            for part in parts(list(dict.fromkeys(t for t in texts if t is not None))):
                encoded.update(zip(part, encoder.encode_batch(part), strict=True))
            pdf = pdf.copy()
            pdf["ids"] = [encoded[t] for t in texts]
            yield pdf

    return run


def encode_column(df: DataFrame, encoder, text_col: str = "text", observation: Observation | None = None) -> DataFrame:
    """Add ``ids array<int>`` by running ``encoder`` in Arrow batches.

    ``mapInPandas`` keeps the frame's partitioning; the encoder object is
    built once per Python worker. NULL ``ids`` marks a row the encoder failed
    on; with ``observation`` those rows are counted (``failed``, ``rows``)
    instead of disappearing silently downstream.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = df.mapInPandas(_encode_frames(encoder, text_col), schema)
    if observation is not None:
        out = out.observe(observation, F.count_if(F.col("ids").isNull()).alias("failed"), F.count(F.lit(1)).alias("rows"))
    return out


# -- decoding (T5) ----------------------------------------------------------------


#: Largest id up to which the vocabulary is looked up by place, as a constant of the plan.
MAX_TABLE_ID = 1_000_000


def decode_sequences(seqs: DataFrame, vocab_bytes: DataFrame, key: str, ids_col: str = "ids", vocab_rows: int | None = None) -> DataFrame:
    """T5: token id sequences back to text, ``(key, text)``, one row per key.

    Each sequence's raw token bytes are put in order and decoded once, so two
    partial tokens can form one character (``20 E6 A0`` + ``B9`` -> " 根") while a
    lone partial token gives U+FFFD. An id outside the vocabulary decodes to
    nothing and an empty sequence to ``""``. A sequence is decoded in its row from
    the vocabulary's bytes by id (config-sized); sequences with one key go together, id by id.
    A vocabulary that is no such table (repeated, negative or huge ids) is joined
    to the ids instead, as are repeated keys: one shuffle on ``key``.
    """
    raw = "raw_bytes" if "raw_bytes" in vocab_bytes.columns else "token_bytes"
    v = vocab_bytes.select("token_id", F.hex(raw).alias("hx"))
    table = _hex_by_id(v)
    if table is None:
        return _decode_by_join(seqs, v, key, ids_col, vocab_rows)
    repeated = seqs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    one = F.col(key).eqNullSafe(F.col("_key"))
    once, twice = seqs, None
    if not repeated.isEmpty():
        once, twice = seqs.join(repeated, one, "left_anti"), seqs.join(repeated, one, "left_semi")
    by_id = F.split(F.lit(",".join(table)), ",")
    hexes = F.transform(ids_col, lambda x: F.coalesce(F.get(by_id, x), F.lit("")))
    out = once.select(key, _text(F.coalesce(F.array_join(hexes, ""), F.lit(""))).alias("text"))
    return out if twice is None else out.unionByName(_decode_by_join(twice, v, key, ids_col, vocab_rows))


def _text(hexes: Column) -> Column:
    return F.make_valid_utf8(F.unhex(hexes).cast("string"))


def _hex_by_id(v: DataFrame) -> list[str] | None:
    """Hex bytes by token id, or None where ids repeat or are not small numbers; the vocabulary is config-sized."""
    if not v.filter(f"token_id is null or token_id < 0 or token_id > {MAX_TABLE_ID}").isEmpty():
        return None
    rows = v.collect()
    table = [""] * (1 + max((r["token_id"] for r in rows), default=0))
    for r in rows:
        table[r["token_id"]] = r["hx"] or ""
    return table if len({r["token_id"] for r in rows}) == len(rows) else None


def _decode_by_join(seqs: DataFrame, v: DataFrame, key: str, ids_col: str, vocab_rows: int | None) -> DataFrame:
    items = seqs.select(key, F.posexplode_outer(ids_col).alias("i", "token_id"))
    joined = items.join(bounded_broadcast(v, known_rows=vocab_rows), "token_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("i", F.coalesce("hx", F.lit("")).alias("hx"))))
    grouped = joined.groupBy(key).agg(parts.alias("p"))
    return grouped.select(key, _text(F.array_join(F.transform("p", lambda x: x["hx"]), "")).alias("text"))
