"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every benchmark item has a 64-bit SimHash of its weighted five-word shingles.
Documents are read once: wherever a document shares shingles with the
benchmark, each window of an item's size gets its SimHash (prefix sums of the
shingles' +-weights, so a window costs one subtraction); for items longer than
the document, the whole document is the window. Fingerprints are cut
into four blocks of 16 bits; two fingerprints within ``radius`` bits
agree within ``radius // 4`` bits in at least one block, so looking every block up
in tables of all neighbours of the items' blocks finds all of them. Candidates
are verified by exact weighted Jaccard similarity of the shingle multisets.

A window without enough benchmark shingles cannot reach the similarity, so
restricting fingerprints to shared regions loses nothing.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokscope.llm.common import mix64, python_tasks, shingle_hashes, text_blocks, word_hashes
from tokscope.session import scratch_path

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Benchmark text broadcast at once; a larger benchmark is matched in several passes.
MAX_BROADCAST_CHARS = 32_000_000
#: Items per multi-index table (a table has up to ``4 * 2517`` entries of two bytes per item).
ITEMS_PER_TABLE = 500

#: Separators of words here: ASCII bytes that are neither letters nor digits.
_SEPARATOR = np.array([b < 128 and not re.match(r"[0-9A-Za-z]", chr(b)) for b in range(256)])


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 for each of the 64 bits of the shingle hashes."""
    bits = np.unpackbits(mix64(hashes.copy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class _Table:
    """Multi-index over the fingerprints of some items: block value -> items within the block radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        flips = [0]
        for k in range(1, radius // BLOCKS + 1):
            flips += [sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), k)]
        flips = np.array(flips, np.uint64)
        self.prints, self.radius, self.blocks = prints, radius, []
        for b in range(BLOCKS):
            own = (prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)
            keys = (own[:, None] ^ flips[None, :]).ravel().astype(np.int64)
            items = np.repeat(np.arange(len(prints), dtype=np.int16), len(flips))
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32), items[order]))

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(window, item, distance)`` of all pairs within the radius, each once."""
        found = []
        for b, (starts, items) in enumerate(self.blocks):
            key = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = (starts[key + 1] - starts[key]).astype(np.int64)
            at = np.repeat(starts[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append(np.repeat(np.arange(len(prints)), n) * len(self.prints) + items[at])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.prints), pair % len(self.prints)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        near = distance <= self.radius
        return window[near], item[near], distance[near]


class Benchmark:
    """Shingles, weights and fingerprints of items, ready for matching documents."""

    def __init__(self, ids: list[int], texts: list[str], width: int, similarity: float, radius: int):
        self.width, self.similarity = width, similarity
        self.ids, self.shingles, self.lengths = [], [], []
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words, offsets = word_hashes(data, np.array([0, len(data)]), _SEPARATOR)
            if not len(words):
                continue
            hashes, _ = shingle_hashes(words, offsets, width)
            self.ids.append(item)
            self.shingles.append(hashes)
            self.lengths.append(len(words))
        self.spans = np.array([len(s) for s in self.shingles], np.int64)
        df = Counter(int(h) for s in self.shingles for h in set(s.tolist()))
        self.known = np.array(sorted(df), np.uint64)
        # A shingle that fewer items hold says more; one that none holds weighs as one that a single item holds.
        n = max(len(self.ids), 1)
        self.other_weight = 1.0 + np.log(n)
        self.weights = np.array([1.0 + np.log(n / df[int(h)]) for h in self.known])
        self.maps = [self._weighted(s) for s in self.shingles]
        prints = [_fingerprints((_signs(s) * self.weight(s)[:, None]).sum(axis=0)[None, :])[0] for s in self.shingles]
        # One index for items of all lengths, so that its size does not grow with their number of lengths.
        self.tables = [(k, _Table(np.array(prints[k : k + ITEMS_PER_TABLE], np.uint64), radius)) for k in range(0, len(prints), ITEMS_PER_TABLE)]
        self.sizes = np.array(self.lengths, np.int64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), self.other_weight)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.weights[at], self.other_weight)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bitmap[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            out[maybe] = self.known[at] == hashes[maybe]
        return out

    def _weighted(self, hashes: np.ndarray) -> dict[int, float]:
        values, counts = np.unique(hashes, return_counts=True)
        return dict(zip(values.tolist(), (self.weight(values) * counts).tolist(), strict=True))

    def jaccard(self, hashes: np.ndarray, item: int) -> float:
        """Exact weighted Jaccard similarity of a window's and an item's shingle multisets."""
        mine, theirs = self._weighted(hashes), self.maps[item]
        both = sum(min(w, theirs[h]) for h, w in mine.items() if h in theirs)
        return both / (sum(mine.values()) + sum(theirs.values()) - both)

    def covers(self, words: np.ndarray, length: int) -> bool:
        """Whether a document shorter than an item of ``length`` words can be similar enough to be compared with it.

        It needs full shingles as the item has them, and their weight at most
        is ``other_weight`` each while the item's at least is one each.
        """
        mine, theirs = len(words) - self.width + 1, length - self.width + 1
        return mine > 0 and mine * self.other_weight >= self.similarity * theirs

    def match_row(self, words: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """Best window per matching item of one document: ``{item: (similarity, start, words, distance)}``."""
        best: dict[int, tuple[float, int, int, int]] = {}
        by_width: dict[int, tuple] = {}
        for length in sorted(set(self.lengths)):
            width = min(self.width, length)
            if len(words) < length and not self.covers(words, length):
                continue
            if width not in by_width:
                if width < self.width:
                    # Items shorter than a shingle: windows of exactly their length, hashed as short rows.
                    rows = np.lib.stride_tricks.sliding_window_view(words, width)
                    h = shingle_hashes(rows.reshape(-1).copy(), np.arange(len(rows) + 1) * width, self.width)[0]
                else:
                    h = shingle_hashes(words, np.array([0, len(words)]), self.width)[0]
                hit, w = self.contains(h), self.weight(h)
                by_width[width] = (h, hit, np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * hit)]), w)
            h, hit, all_w, hit_w, w = by_width[width]
            # A document shorter than the item is one window, the whole of it.
            n_words = min(length, len(words))
            span = n_words - width + 1
            starts = np.arange(len(h) - span + 1)
            total = all_w[starts + span] - all_w[starts]
            starts = starts[hit_w[starts + span] - hit_w[starts] >= self.similarity * total - 1e-9]
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + span
            for first in range(lo, hi, 1 << 16):
                mine = starts[(starts >= first) & (starts < first + (1 << 16))]
                if not len(mine):
                    continue
                end = min(first + (1 << 16) + span, hi)
                sums = np.concatenate([np.zeros((1, 64), np.float64), np.cumsum(_signs(h[first:end]) * w[first:end, None], axis=0, dtype=np.float64)])
                # The tolerance keeps a sum that is zero up to rounding on the side a direct sum puts it.
                prints = _fingerprints(sums[mine - first + span] - sums[mine - first] - 1e-9)
                found = [(window, item + base, distance) for base, table in self.tables for window, item, distance in [table.lookup(prints)]]
                window, item_of, distances = (np.concatenate(c) for c in zip(*found, strict=True))
                sized = np.flatnonzero(self.sizes[item_of] == length)
                for k, item, distance in zip(window[sized].tolist(), item_of[sized].tolist(), distances[sized].tolist(), strict=True):
                    start = int(mine[k])
                    sim = self.jaccard(h[start : start + span], item)
                    if sim >= self.similarity - 1e-12 and (item not in best or sim > best[item][0]):
                        best[item] = (sim, start, n_words, int(distance))
        return best


LEAK = "item_id long, similarity double, word_start long, n_words int, distance int"


def leak_finder(shared, similarity: float, radius: int, width: int):
    """Column function ``text -> array of`` :data:`LEAK` for the benchmark items ``(ids, texts)`` of a broadcast."""
    key = uuid.uuid4().hex

    @F.arrow_udf(f"array<struct<{LEAK.replace(' ', ':').replace(',:', ',')}>>")
    def leaks(text: pa.Array) -> pa.Array:
        bench = _benchmark(key, shared, width, similarity, radius)
        shortest = min(bench.lengths, default=0)
        found: list[list[tuple]] = [[] for _ in range(len(text))]
        for first, last, data, offsets in text_blocks(pa.RecordBatch.from_arrays([text], ["text"])) if bench.ids else ():
            words, bounds = word_hashes(data, offsets, _SEPARATOR)
            shingles, row_of = shingle_hashes(words, bounds, width)
            # Rows that share a full shingle, or that may hold an item shorter than one.
            share = np.zeros(last - first, bool)
            share[row_of[bench.contains(shingles)]] = True
            if shortest < width:
                share |= np.diff(bounds) >= shortest
            for r in np.flatnonzero(share):
                found[first + r] = [(bench.ids[i], *m) for i, m in sorted(bench.match_row(words[bounds[r] : bounds[r + 1]]).items())]
        flat = list(zip(*(x for f in found for x in f), strict=True)) or [[]] * 5
        types = [pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32()]
        structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types, strict=True)], [x.split()[0] for x in LEAK.split(", ")])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32), structs)

    return leaks


_built: dict[str, Benchmark] = {}


def _benchmark(key: str, shared, width: int, similarity: float, radius: int) -> Benchmark:
    """The tables of a broadcast benchmark, built once per Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(*shared.value, width, similarity, radius)
    return _built[key]


def _passes(benchmark: DataFrame, similarity: float, radius: int, width: int) -> Iterator[tuple[Column, Broadcast, bool]]:
    """Per part of the benchmark: the leaks of a row as a column, the part's broadcast, and whether it is the only one.

    A part has at most about ``MAX_BROADCAST_CHARS`` characters of text.
    """
    spark = benchmark.sparkSession
    python_tasks(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // MAX_BROADCAST_CHARS))
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in part], [r["text"] for r in part]))
        yield leak_finder(shared, similarity, radius, width)(F.col("text").cast("string")), shared, passes == 1


def _stored(df: DataFrame, shared: Broadcast) -> DataFrame:
    """End a pass: write its rows, partitions as they are, and release its broadcast."""
    path = scratch_path(df.sparkSession, "leak-pass")
    df.write.parquet(path)
    shared.destroy()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = MIN_SIMILARITY, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """Benchmark items inside documents: one row per (row of ``docs``, item) with the best window.

    ``docs`` needs ``doc_id, text``, ``benchmark`` needs ``item_id, text``; other
    columns are ignored. Words are runs of letters and digits, A-Z
    lower-cased. Returns ``doc_id, item_id, similarity, word_start, n_words,
    distance``; the window is given in words.

    Edge cases: null or empty texts match nothing, on either side. Items of
    fewer than five words are one shingle. Items with equal texts are
    all reported; the earliest of equally similar windows counts. A benchmark
    above ``MAX_BROADCAST_CHARS`` is taken in parts, one pass after the other.
    Shingle weights are those of a part's own items, so distances, and the
    similarities of edited windows, can differ a little from those of one pass. Repeated
    rows are reported each. Empty tables give an empty result.
    """
    found = None
    for leaks, shared, only in _passes(benchmark, similarity, radius, width):
        rows = docs.select("doc_id", F.explode(leaks).alias("leak")).select("doc_id", "leak.*")
        if only:
            return rows
        rows = _stored(rows, shared)
        found = rows if found is None else found.unionByName(rows)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = MIN_SIMILARITY, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without a benchmark item in them, all columns unchanged."""
    for leaks, shared, only in _passes(benchmark, similarity, radius, width):
        docs = docs.withColumn("__llm_leaks", leaks).filter(F.size("__llm_leaks") == 0).drop("__llm_leaks")
        if only:
            return docs
        docs = _stored(docs, shared)
    return docs
