"""Helpers shared by the corpus operators: tables, column expressions, Arrow buffers."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.session import _context as spark_context
from tokscope.session import default_parallelism, ensure_checkpoint_dir, read_table, scratch_path, ship_package

# Fixed by the result contracts: the bytes that separate words and are stripped from lines.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Text bytes handled by one numpy block inside a Python task.
BLOCK_BYTES = 1 << 18
#: Bytes of one Arrow batch (a larger row is a batch of its own).
BATCH_BYTES = 4 << 20
#: Row group of a written table that holds texts, in the writer's memory. A task reads a
#: column of a row group at once, on the heap and again in the file system's direct buffer.
TEXT_GROUP_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def compact(df: DataFrame) -> DataFrame:
    """Even out partitions before a write: about one file per core instead of one per task.

    The rebalance is a shuffle of the result alone, so a long map stage above
    it keeps its parallelism.
    """
    return df.hint("rebalance").coalesce(default_parallelism(df.sparkSession))


def written(df: DataFrame, name: str, even: bool = True, texts: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it back.

    With ``even`` false no shuffle is added for it; that suits a large result
    that comes out of a shuffle anyway. A table with ``texts`` gets row groups of ``TEXT_GROUP_BYTES``.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    options = {"parquet.block.size": str(TEXT_GROUP_BYTES)} if texts else {}
    (compact(df) if even else df.coalesce(default_parallelism(spark))).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_tasks(spark: SparkSession) -> None:
    """Prepare a session for Python tasks over texts: ship the code, bound the Arrow batches.

    A batch of 10,000 long texts would be hundreds of MB in the worker and
    again in the JVM; unless the session says otherwise, a batch ends after ``BATCH_BYTES``.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("64m", "64mb", "67108864b", "67108864"):
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what this worker's allocators (Arrow's and the C library's) hold free.

    A worker lives on idle between its tasks, beside an executor whose heap is full by then.
    """
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def drop_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no plan needs any more deleted now.

    Spark deletes them when the driver's JVM collects garbage, which few large steps may not make it do for long.
    """
    sc = spark_context(spark)
    if sc is not None:
        gc.collect()
        sc._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on pure ASCII, the rest goes through ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow batch into blocks of about ``limit`` text bytes.

    Yields ``(first_row, last_row, bytes, offsets)``: the UTF-8 bytes of rows
    ``first_row..last_row-1`` without a copy and the ``n + 1`` offsets of the
    rows within them. Null texts are empty. A row larger than the limit is a
    block of its own.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return
    _, off_buf, data_buf = arr.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64, count=arr.offset + n + 1)[arr.offset :]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x9E3779B97F4A7C15
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER_CODE = _BYTE_CODE[_LOWERED]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for ``i < n`` (grown on demand, kept)."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[i] * base**i`` with a leading zero."""
    up, _ = powers(len(codes) + 1)
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words of each row of a block.

    Words are runs of bytes that are not ``space`` (a mask of 256 bytes, the
    default being ``[\\x20\\x09-\\x0D]``) and never cross rows. Returns the
    hashes in order and the ``n + 1`` word offsets of rows.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = inside[last]
    begins, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = prefix_hash(_LOWER_CODE[data])
    _, down = powers(n + 1)
    hashes = mix64((sums[ends] - sums[begins]) * down[begins])
    return hashes, np.searchsorted(begins, offsets)


_SHINGLE_KEYS = mix64(np.arange(101, 165, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each row, in order, and their row numbers.

    A row with 1 to ``width - 1`` words has one shingle, the whole sequence.
    """
    n = len(words)
    counts = np.diff(word_offsets)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row_of = np.repeat(np.arange(len(counts)), counts)
    acc = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        acc[: n - k] += words[k:] * _SHINGLE_KEYS[k]
    keep = np.arange(n) + width <= word_offsets[1:][row_of]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for r in short:
        a, b = word_offsets[r], word_offsets[r + 1]
        acc[a] = (words[a:b] * _SHINGLE_KEYS[width : width + (b - a)]).sum() + np.uint64(b - a)
        keep[a] = True
    return mix64(acc[keep]), row_of[keep]


__all__ = [
    "BLOCK_BYTES",
    "LOWER",
    "SPACE_CHARS",
    "SPACE_CLASS",
    "UPPER",
    "ascii_lower",
    "compact",
    "documents",
    "drop_shuffles",
    "give_back",
    "ensure_checkpoint_dir",
    "mix64",
    "powers",
    "python_tasks",
    "prefix_hash",
    "read_table",
    "scratch_path",
    "shingle_hashes",
    "strip_spaces",
    "text_blocks",
    "word_hashes",
    "written",
]
