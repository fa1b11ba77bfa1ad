"""Best-two-fit packing of documents into fixed-size token sequences.

Documents are encoded in tasks; only piece lengths matter for packing, and
there are at most ``max_tokens`` different ones. The histogram of lengths
(at most ``max_tokens`` rows, whatever the corpus) goes to the driver, which
plans *bin patterns with multiplicities*: fill a bin greedily with the largest
piece that fits, then replace its smallest piece by two unpacked ones that
fill the widened gap more tightly, and use that pattern as often as the
remaining counts allow. Each pattern uses up at least one length, so the plan
is as small as the histogram. Tasks then place every piece by its rank among
the pieces of its length, so billions of bins are filled without a global pass.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokscope.llm.common import python_tasks, written

MAX_TOKENS = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER):
    """Encoder of a byte-level BPE ``tokenizer.json``; its added tokens are the special tokens.

    The vocabulary is run by ``tiktoken`` (same merges, same split pattern, same
    ids as ``tokenizers``; three times its speed per core). ``encode`` with
    ``allowed_special="all"`` cuts added tokens out of the text as
    ``tokenizers`` does, ``encode_ordinary`` spells them out.
    """
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    if odd := [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens {odd} take in or need spaces around them, which is not supported")
    special = {t["content"]: t["id"] for t in added}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids; only the first may be short."""
    if n <= max_tokens:
        return [(0, n)]
    head = n % max_tokens
    starts = ([0] if head else []) + list(range(head, n, max_tokens))
    return [(s, head if s == 0 and head else max_tokens) for s in starts]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def encode_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode ``doc_id, text`` and cut long documents; one row per piece (``ids`` on demand)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(ids_of, texts, strict=True):
                ids = np.array(enc.encode(text.as_py() or "", allowed_special="all"), dtype="<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    part = ids[start : start + length]
                    for col, v in zip(cols, (doc, piece, start, length, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None), strict=True):
                        col.append(v)
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Plan ``(lengths in a bin, number of such bins)`` that uses up ``counts`` exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan = []
    while left.any():
        free = left.copy()
        lengths: list[int] = []
        gap = capacity

        def take(size: int) -> None:
            lengths.append(size)
            free[size] -= 1

        while gap > 0 and (fits := np.flatnonzero(free[: gap + 1])).size:
            take(int(fits[-1]))
            gap -= lengths[-1]
        while gap > 0 and len(lengths) > 1:
            small = min(lengths)
            room = gap + small
            sizes = np.flatnonzero(free[: room + 1])
            if not sizes.size:
                break
            # For each size the largest partner that still fits (twice the same needs two of it).
            at = np.searchsorted(sizes, room - sizes, side="right") - 1
            partner = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
            alone = (partner == sizes) & (free[sizes] < 2)
            partner[alone] = np.where(at[alone] > 0, sizes[np.maximum(at[alone] - 1, 0)], 0)
            total = np.where(partner > 0, sizes + partner, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            lengths.remove(small)
            free[small] += 1
            take(int(sizes[best]))
            take(int(partner[best]))
            gap = room - int(total[best])
        used, times = np.unique(lengths, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= times * n
        plan.append((sorted(lengths, reverse=True), n))
    return plan


def _placement(plan: list[tuple[list[int], int]], capacity: int):
    """Per length: first ranks of its plan entries, their first bin, and the offsets inside a bin."""
    entries: dict[int, list] = {}
    next_bin, seen = 0, np.zeros(capacity + 1, np.int64)
    for lengths, n in plan:
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for size in sorted(set(lengths)):
            offsets = starts[np.array(lengths) == size]
            entries.setdefault(size, []).append((int(seen[size]), next_bin, offsets))
            seen[size] += n * len(offsets)
        next_bin += n
    return entries


def ranked_by_length(pieces: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``rank``: 0-based number of a piece among those of its length.

    A length that many documents share is numbered in hash buckets whose sizes
    are added up first, so no task numbers a whole length.
    """
    buckets = max(1, -(-pieces.count() // rows_per_bucket))
    b = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = b.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32"))
    return b.withColumn("local", local).join(offsets, ["length", "b"]).withColumn("rank", F.col("base") + F.col("local") - 1).drop("b", "local", "base")


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most ``max_tokens`` ids.

    Takes ``doc_id`` and ``text`` (other columns are ignored, whatever their
    names). Returns one row per piece: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` and ``ids`` if asked for.

    Edge cases: a null or empty text is the end id alone. A repeated row is
    packed again as a document of its own. An empty table gives an empty
    result. Equal lengths are interchangeable; ties go by hash bucket, id and piece.
    """
    pieces = written(encode_pieces(docs, max_tokens, tokenizer, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    entries = _placement(best_two_fit(histogram, max_tokens), max_tokens)
    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(place)
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rows = entries[int(size)]
            which = np.searchsorted([r[0] for r in rows], ranks[at], side="right") - 1
            for w in np.unique(which):
                first, bin0, offsets = rows[w]
                mine = at[which == w]
                q = ranks[mine] - first
                seq[mine] = bin0 + q // len(offsets)
                off[mine] = offsets[q % len(offsets)]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked_by_length(pieces).withColumn("at", placed("length", "rank"))
    cols = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset"]
    return out.select(*cols, *(["ids"] if with_ids else []))
