"""Exact ranked lexical search with ball trees over sparse document vectors.

A document is a sparse integer vector over the terms that some item asks for;
an item's score is the inner product with the 0/1 vector of its terms. Tasks
gather blocks of documents, build a ball tree (centroid and radius) over each
and search it best-first for every item: no document in a ball scores more than
``<q, centroid> + |q| * radius``, so a ball whose bound (widened by the
rounding error of its computation) is below the item's tenth score so far is
left out. Leaves are scored exactly in integers. The best of all tasks are
merged per item.

Items are taken in passes of bounded size, so the broadcast vocabulary and the
state of a task do not grow with the number of items; documents are never
shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokscope.llm.common import _LOWER_CODE, LOWER, UPPER, mix64, powers, prefix_hash, python_tasks, text_blocks, written

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_IN_TERM = np.ones(256, dtype=bool)  # bytes of UTF-8 that belong to terms: 0-9, A-Z, a-z and all beyond ASCII
_IN_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32

TOP_K = 10
#: Text bytes of the items of one pass; their vocabulary and results are held by every task.
PASS_BYTES = 4 << 20
#: Documents and vector entries of one tree.
BLOCK_DOCS, BLOCK_ENTRIES = 16_384, 4 << 20
#: Smallest number of documents worth splitting, and the numbers that all centroids of a tree may take.
LEAF_DOCS, CENTROID_CELLS = 32, 4 << 20
UNIT = 2.0**-53


def item_terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER))))


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every term of a block's rows and the ``n + 1`` term offsets of the rows."""
    inside = _IN_TERM[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    start[first], stop[last] = inside[first], inside[last]
    begins = np.flatnonzero(start)
    return begins, np.flatnonzero(stop) + 1, np.searchsorted(begins, offsets)


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_hash(_LOWER_CODE[data])
    _, down = powers(len(data) + 1)
    return mix64((sums[ends] - sums[begins]) * down[begins])


class Vocabulary:
    """The terms of a pass, found by hash in blocks of text; a hit's bytes are compared with the term's."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.length = np.array([len(r) for r in raw], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(self.length)
        self.begin = ends - self.length
        hashes = _hashes(self.bytes, self.begin, ends) if len(raw) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of one pass share a 64-bit hash; use another PASS_BYTES")

    def __len__(self) -> int:
        return len(self.length)

    def find(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``begins`` of words that are terms, and the terms' numbers."""
        if not len(begins) or not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _hashes(data, begins, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[hit]]
        same = self.length[term] == ends[hit] - begins[hit]
        hit, term = hit[same], term[same]
        size = self.length[term]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = _LOWERED[data[np.repeat(begins[hit], size) + inner]] != self.bytes[np.repeat(self.begin[term], size) + inner]
        if differ.any():
            bad = np.unique(np.repeat(np.arange(len(hit)), size)[differ])
            hit, term = np.delete(hit, bad), np.delete(term, bad)
        return hit, term

    def count(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block of a batch: first row, terms with repeats of its rows, and sorted ``(row, term, tf)`` arrays."""
        for row, end, data, offsets in text_blocks(batch):
            begins, ends, bounds = _spans(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
            hit, term = self.find(data, begins, ends)
            key = (np.searchsorted(bounds, hit, side="right") - 1) * max(len(self), 1) + term
            key, tf = np.unique(key, return_counts=True)
            yield row, np.diff(bounds), key // max(len(self), 1), key % max(len(self), 1), tf


@dataclass
class Corpus:
    """Counts over all documents: with a term, all their terms, and documents holding each term."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(d) + 1))) for d in self.df], dtype=np.int64)

    def entries(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Vector entries of documents with ``n`` terms; integer division as in the score's definition."""
        if self.n_terms and 90 * int(n.max(initial=0)) * self.n_docs >= 1 << 63:
            m = np.array([10 + (90 * int(x) * self.n_docs) // self.n_terms for x in n], dtype=np.int64)
        else:
            m = 10 + (90 * n * self.n_docs) // max(self.n_terms, 1)
        tf = tf.astype(np.int64)
        return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


def _take(indptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ``rows`` and their own row pointers."""
    size = indptr[rows + 1] - indptr[rows]
    ptr = np.concatenate([[0], np.cumsum(size)])
    return np.arange(ptr[-1]) + np.repeat(indptr[rows] - ptr[:-1], size), ptr


class BallTree:
    """Ball tree over the rows of a sparse matrix (each with an entry at least); rows of a node are contiguous in ``order``."""

    def __init__(self, indptr: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int):
        n = len(indptr) - 1
        self.leaf_docs = max(LEAF_DOCS, -(-4 * n * width // CENTROID_CELLS))
        self.width = width
        self.error = 8 * (width + 8) * UNIT
        self.centroids, self.radius, self.spread, self.children, self.rows = [], [], [], [], []
        floats = values.astype(np.float64)
        self.order = np.arange(n)
        stack = [(0, n, -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node = len(self.rows)
            if parent >= 0:
                self.children[parent][side] = node
            self.rows.append((a, b))
            self.children.append([-1, -1])
            mine = self.order[a:b]
            pos, ptr = _take(indptr, mine)
            c, x = cols[pos], floats[pos]
            square = np.add.reduceat(x * x, ptr[:-1])
            center = np.bincount(c, weights=x, minlength=width) / (b - a)
            far = self._distance(square, c, x, ptr, center)
            # Cancellation may hide this much of a squared distance.
            lost = self.error * (square.max() + center @ center)
            self.centroids.append(center)
            self.radius.append(math.sqrt(far.max() + lost) * (1 + self.error))
            self.spread.append(math.sqrt(center @ center) + self.radius[-1])
            if b - a > self.leaf_docs:
                one = self._dense(c, x, ptr, int(far.argmax()))
                from_one = self._distance(square, c, x, ptr, one)
                two = self._dense(c, x, ptr, int(from_one.argmax()))
                lean = from_one - self._distance(square, c, x, ptr, two)
                by = np.argsort(lean, kind="stable")
                cut = int((lean < 0).sum())
                if not (b - a) // 16 <= cut <= (b - a) - (b - a) // 16:
                    cut = (b - a) // 2  # nearly all on one side, or all alike: halves keep the tree shallow
                self.order[a:b] = mine[by]
                stack += [(a, a + cut, node, 0), (a + cut, b, node, 1)]
        self.centroids = np.array(self.centroids)
        self.radius, self.spread = np.array(self.radius), np.array(self.spread)
        pos, self.ptr = _take(indptr, self.order)
        self.cols, self.values = cols[pos], values[pos]

    def _dense(self, c: np.ndarray, x: np.ndarray, ptr: np.ndarray, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[c[ptr[row] : ptr[row + 1]]] = x[ptr[row] : ptr[row + 1]]
        return out

    @staticmethod
    def _distance(square: np.ndarray, c: np.ndarray, x: np.ndarray, ptr: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.maximum(square - 2 * np.add.reduceat(x * point[c], ptr[:-1]) + point @ point, 0)

    def search(self, terms: np.ndarray, best: list, ids: list, k: int) -> int:
        """Add the documents of this tree to ``best`` (a heap of at most ``k``); returns the leaves scored."""
        norm = math.sqrt(len(terms))
        bound = self.centroids[:, terms].sum(axis=1) + norm * self.radius + (self.error * norm) * self.spread
        asked = np.zeros(self.width, dtype=np.int64)
        asked[terms] = 1
        queue, scored = [(-bound[0], 0)], 0
        while queue:
            least = best[0][0] if len(best) == k else 1
            value, node = heapq.heappop(queue)
            if -value < least:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= least:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            scored += 1
            a, b = self.rows[node]
            span = slice(self.ptr[a], self.ptr[b])
            scores = np.add.reduceat(self.values[span] * asked[self.cols[span]], self.ptr[a:b] - self.ptr[a])
            for i in np.flatnonzero(scores >= least):
                doc = ids[self.order[a + i]]
                entry = (int(scores[i]), doc is not None, -(doc or 0))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _corpus_task(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value["vocabulary"]
        df = np.zeros(len(vocabulary) + 2, dtype=np.int64)  # the last two: documents with a term, all terms
        for batch in batches:
            for _, n, _, term, _ in vocabulary.count(batch):
                df[:-2] += np.bincount(term, minlength=len(vocabulary))
                df[-2:] += (int((n > 0).sum()), int(n.sum()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    return run


def _search_task(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        vocabulary, corpus, weight, items = s["vocabulary"], s["corpus"], s["weight"], s["items"]
        best: list[list] = [[] for _ in items]
        ids: list = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def search() -> None:
            if parts:
                size, cols, values = (np.concatenate(p) for p in zip(*parts, strict=True))
                tree = BallTree(np.concatenate([[0], np.cumsum(size)]), cols, values, len(vocabulary))
                for heap, terms in zip(best, items, strict=True):
                    if len(terms):
                        tree.search(terms, heap, ids, k)
            ids.clear()
            parts.clear()

        entries = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, n, row, term, tf in vocabulary.count(batch):
                x = corpus.entries(n, row, term, tf, weight)
                row, term, x = row[x > 0], term[x > 0], x[x > 0]
                size = np.bincount(row, minlength=len(n))
                held = np.flatnonzero(size)
                if len(held):  # documents without an entry score 0 for every item
                    ids.extend(names[first + r] for r in held)
                    parts.append((size[held], term, x))
                    entries += len(x)
                if len(ids) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    search()
                    entries = 0
        search()
        rows = [(i, -doc if known else None, score) for i, heap in enumerate(best) for score, known, doc in heap]
        out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["item", "doc_id", "score"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item, first within hash groups of tasks' results, then among the groups."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    split = found.withColumn("split", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = split.withColumn("rank", F.row_number().over(Window.partitionBy("item", "split").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("split")


def _one_pass(docs: DataFrame, rows: list, k: int) -> tuple[DataFrame, Broadcast]:
    """Search for collected ``(item_id, text)`` rows; the broadcast can be destroyed once the result is written."""
    spark = docs.sparkSession
    asked = [item_terms(r["text"]) for r in rows]
    terms = sorted(set().union(*asked))
    number = {t: i for i, t in enumerate(terms)}
    vocabulary = Vocabulary(terms)
    shared = spark.sparkContext.broadcast({"vocabulary": vocabulary})
    counts = docs.select("text").mapInArrow(_corpus_task(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counts.collect()}  # a row per term of the pass
    shared.destroy()
    width = len(terms)
    corpus = Corpus(found.get(width, 0), found.get(width + 1, 0), np.array([found.get(i, 0) for i in range(width)], dtype=np.int64))
    items = [np.array(sorted(number[t] for t in a), dtype=np.int64) for a in asked]
    shared = spark.sparkContext.broadcast({"vocabulary": vocabulary, "corpus": corpus, "weight": corpus.weights(), "items": items})
    hits = _merged(docs.mapInArrow(_search_task(shared, k), "item int, doc_id long, score long"), k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), shared


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The ``k`` best documents (``doc_id, text``) of each item (``item_id, text``): ``item_id, rank, doc_id, score``.

    Other columns are ignored, whatever their names. The score is the module's
    integer form of a saturating term-frequency weight with length
    normalisation; only scores above 0 are returned, equal scores by ascending
    ``doc_id``.

    Edge cases: a null text has no terms. A null ``doc_id`` is a document
    (last among equal scores). Rows with one ``doc_id`` are documents of their
    own. Equal item rows count once; items of one ``item_id`` with different
    texts are ranked on their own. No documents or no items: an empty result.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    done = []
    for i in range(passes):
        # About pass_bytes of text (a single longer item is its own bound).
        result, shared = _one_pass(docs, asked.filter(of == i).collect(), k)
        if passes == 1:
            return result
        done.append(written(result, "lexical-search"))
        shared.destroy()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
