"""Jaccard self-join of n-gram sets by prefix filtering and prefix trees.

Every document is the set of its word n-grams, each set sorted by one global
order: rare n-grams first, by hash, then the ``2**18`` most frequent ones (as
counted in chunks), by their counts. Two sets with similarity ``t`` share an
n-gram among their first ``n - ceil(t n) + 1``, so only these prefixes are
shuffled, and only n-grams that two different sets have in their prefix go on,
for those documents that have a partner there whose sketch (members per hash
range, a bound of every overlap from above) allows a link.

Candidates are verified inside tasks with a prefix tree: ordered sets that
begin alike share the nodes of their common part, a probe walks the tree
once for all of them, and a subtree is left as soon as its remaining lengths
cannot reach the needed overlap. Documents with equal sets are one node from
the start. First each prefix n-gram's documents are compared with one *leader*
(linear in the group, which settles groups of copies). What still lies in
different components is joined to families, again unless sketches forbid it.
Within a family, block by block, the
shared prefix n-grams of each pair are counted: sets that are linked share far
more of them than one, which leaves few pairs to look up in the block's tree.
A text is read once per block, not once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokscope.llm.common import drop_shuffles, mix64, python_tasks, shingle_hashes, text_blocks, word_hashes, written
from tokscope.llm.components import connected_components

#: So many n-grams at most count as frequent, those with the largest counts.
MAX_FREQUENT = 1 << 18
#: Set members counted at a time, and the n-grams told of each time at most.
_COUNT_CHUNK = 1 << 22
_COUNT_TOLD = 1 << 15
#: Counts up to this one (and up to that of one member in ``MAX_FREQUENT``) are told apart when the frequent n-grams are chosen.
_COUNT_APART = 1 << 12
_HOT = np.uint64(1 << 63)
#: Sets compared with each other in one block.
BLOCK_SETS = 256
#: Documents fetched by broadcast id up to this number (8 bytes each), by a shuffle join beyond.
MAX_BROADCAST_IDS = 2_000_000
LEADER_ROUNDS = 2
#: Rows of one leading document that are counted in one task.
ROWS_PER_LEAD = 5_000
#: N-grams with fewer documents compare sketches pair by pair.
_FEW = 8


def needed_overlap(n: int, m: int, percent: int) -> int:
    """Smallest intersection with ``100 * i >= percent * (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Distinct 63-bit n-gram hashes per row of a block, sorted."""
    hashes, row_of = shingle_hashes(*word_hashes(data, offsets), width)
    hashes >>= np.uint64(1)
    bounds = np.searchsorted(row_of, np.arange(len(offsets)))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _places(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams, sorted, and the place of each in the order of their counts."""
    values = ids.view(np.uint64)
    place = np.empty(len(values), np.uint64)
    place[np.lexsort((values, counts))] = np.arange(len(values), dtype=np.uint64)
    order = np.argsort(values)
    return values[order], place[order]


def _ordered(values: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of a sorted set in the global order: a frequent n-gram is its place with the top bit, and so comes last."""
    known, place = hot
    if not len(known) or not len(values):
        return values
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    is_hot = known[at] == values
    return np.concatenate([values[~is_hot], np.sort(place[at[is_hot]]) | _HOT]) if is_hot.any() else values


def _head(values: np.ndarray, hot: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """The first ``size`` of :func:`_ordered`, mostly without looking at the rest."""
    known, place = hot
    if not len(known):
        return values[:size]
    rare, places, at, left = [], [], 0, size
    while left > 0 and at < len(values):
        part = values[at : at + left + 16]
        spot = np.minimum(np.searchsorted(known, part), len(known) - 1)
        is_hot = known[spot] == part
        rare.append(part[~is_hot][:left])
        places.append(place[spot[is_hot]])
        at, left = at + len(part), left - len(rare[-1])
    if left > 0 and places:
        rare.append(np.sort(np.concatenate(places))[:left] | _HOT)
    return np.concatenate(rare) if rare else values[:0]


class PrefixTree:
    """Sorted sets stored by their common beginnings."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        big = [s.astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=big.__getitem__)
        self.order = np.array(order, np.int64)
        self.root = self._node(order, 0, 0) if order else None

    def _node(self, order: list[int], depth: int, at: int) -> tuple:
        """``(run of n-grams, depth after it, sets ending here, children, least and largest size below, first and last place in the order)``."""
        first, last = self.sets[order[0]], self.sets[order[-1]]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        ends = [i for i in order if len(self.sets[i]) == end]
        rest = order[len(ends) :]
        children, k = [], 0
        while k < len(rest):
            token, j = self.sets[rest[k]][end], k + 1
            while j < len(rest) and self.sets[rest[j]][end] == token:
                j += 1
            children.append(self._node(rest[k:j], end, at + len(ends) + k))
            k = j
        sizes = [len(self.sets[i]) for i in order]
        return first[depth:end], end, ends, children, min(sizes), max(sizes), at, at + len(order)

    def search(self, probe: np.ndarray, percent: int, among: np.ndarray | None = None) -> list[int]:
        """Indexes of the sets whose similarity with ``probe`` is at least ``percent``.

        With ``among``, a mask of the sets, only branches that lead to one of those are walked, and only those are told.
        """
        found, n = [], len(probe)
        wanted = None if among is None else np.concatenate([[0], np.cumsum(among[self.order])])
        stack = [(self.root, 0)] if self.root and n else []
        while stack:
            (run, depth, ends, children, least, largest, lo, hi), overlap = stack.pop()
            if 100 * largest < percent * n or 100 * n < percent * least:
                continue
            if wanted is not None and wanted[lo] == wanted[hi]:
                continue
            left = n
            if len(run):
                at = np.searchsorted(probe, run)
                overlap += int((probe[np.minimum(at, n - 1)] == run).sum())
                left = n - int(np.searchsorted(probe, run[-1], side="right"))
            for i in ends:
                if depth and overlap >= needed_overlap(n, depth, percent) and (among is None or among[i]):
                    found.append(i)
            # Below this node at most so many more n-grams can be shared.
            need = needed_overlap(n, max(least, -(-percent * n // 100)), percent)
            if children and overlap + min(left if len(run) else n, largest - depth) >= need:
                stack.extend((c, overlap) for c in children)
        return found


def _set_rows(width: int):
    """Task: ``(0, doc_id, n, h1, h2, sketch)`` per document, ``(1, n-gram, count)`` per n-gram of several sets of a chunk, ``(2, 0, members)``.

    Equal sets of a chunk count once. The counts only make the global order, which may be any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = [], set(), 0
        names = ["kind", "id", "n", "h1", "h2", "sketch"]

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = np.flatnonzero(counts >= 2)
            if len(often) > _COUNT_TOLD:
                often = often[np.argpartition(counts[often], -_COUNT_TOLD)[-_COUNT_TOLD:]]
            k = len(often) + 1
            zero = pa.array(np.zeros(k, np.int64))
            kind = pa.array(np.append(np.ones(k - 1, np.int32), 2), pa.int32())
            return pa.RecordBatch.from_arrays([kind, pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(counts[often], total)), zero, zero, pa.nulls(k, pa.binary())], names)

        for batch in batches:
            n, h1, h2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            sketches = []
            for first, _, data, offsets in text_blocks(batch):
                for k, s in enumerate(_sets(data, offsets, width), first):
                    n[k], h1[k], h2[k] = len(s), mix64(s.copy()).sum(), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                    sketches.append(sketch(s))
                    if (key := (n[k], h1[k], h2[k])) not in seen:
                        seen.add(key)
                        held.append(s)
                        total += len(s)
                if total >= _COUNT_CHUNK:
                    yield frequent()
                    held, seen, total = [], set(), 0
            kind = pa.array(np.zeros(batch.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([kind, batch.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sketches, pa.binary())], names)
        if held:
            yield frequent()

    return run


def _prefix_rows(width: int, percent: int, shared):
    """Task: ``(token, doc_id, n)`` for every n-gram in a document's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for first, _, data, offsets in text_blocks(batch):
                sets = _sets(data, offsets, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                heads = [_head(s, hot, prefix_length(len(s), percent)) for s in sets]
                k = [len(h) for h in heads]
                own = np.repeat(np.arange(first, first + len(sets)), k)
                flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(ids[own]), pa.array(np.repeat(sizes, k).astype(np.int32))], ["token", "doc_id", "n"])

    return run


def _linked(width: int, percent: int, shared):
    """Task over rows sorted by group: verified links of each group.

    A group's rows are ``(g1, g2, g3, probe, doc_id, root, text)``. Rows with
    ``probe`` 1 are looked up in the tree of those with 0; with 2, a row is
    both. Links within one component (by ``root``, updated as links are
    found) are not looked for.
    """

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        stored = [r for r in rows if r[0] != 1]
        parent = {r[2]: r[2] for r in rows}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        tree = PrefixTree([r[3] for r in stored])
        for kind, doc, root, keys in rows:
            if kind == 0 or all(find(s[2]) == find(root) for s in stored):
                continue
            for i in tree.search(keys, percent):
                a, b = find(root), find(stored[i][2])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield doc, stored[i][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        group, rows, links = None, [], []

        def out() -> pa.RecordBatch:
            a, b = [x[0] for x in links], [x[1] for x in links]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
            for first, _, data, offsets in text_blocks(batch):
                for k, s in enumerate(_sets(data, offsets, width), first):
                    *g, kind, doc, root = keys[k]
                    if g != group:
                        links.extend(solve(rows))
                        group, rows = g, []
                    rows.append((kind, doc, root, _ordered(s, hot)))
            if links:
                yield out()
                links = []
        links.extend(solve(rows))
        yield out()

    return run


def shared_prefix_needed(n: int, m: int, percent: int) -> int:
    """N-grams that two linked sets must share within their prefixes.

    Of two prefixes one ends first in the global order; whatever the sets
    share and is not in both prefixes then lies behind that one, in at most
    ``n - prefix_length(n)`` places.
    """
    behind = max(n - prefix_length(n, percent), m - prefix_length(m, percent))
    return max(1, needed_overlap(n, m, percent) - behind)


def sketch(values: np.ndarray) -> bytes:
    """Members of a sorted 63-bit set per hash range, one byte each; empty if one overflows.

    Small sets have 4 members a range, larger ones 8 and 16: unrelated sets then hardly ever look alike, whatever their size.
    """
    n = max(len(values), 1)
    k = max(5, int(np.ceil(np.log2(n / 4)))) if n <= 512 else max(7, int(np.ceil(np.log2(n / 8)))) if n <= 4096 else max(9, int(np.ceil(np.log2(n / 16))))
    counts = np.bincount((values >> np.uint64(63 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() <= 255 else b""


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the intersection of two sets by their sketches: ranges share at most the smaller count."""
    # An empty sketch says nothing, whatever the other one is.
    if not len(a) or not len(b):
        return 1 << 62
    if len(a) != len(b):
        if len(a) > len(b):
            a, b = b, a
        b = b.reshape(len(a), -1).sum(axis=1)
    return int(np.minimum(a, b).sum(dtype=np.int64))


class _Sketches:
    """Sketches of one n-gram's documents, sorted by size, compared one with many."""

    def __init__(self, sizes: list[int], sketches: list[np.ndarray], percent: int):
        self.sizes, self.sketches, self.percent = np.array(sizes, np.int64), sketches, percent
        self.lengths = np.array([len(x) for x in sketches], np.int64)
        #: For each document the first one behind it that is too large.
        self.ends = np.searchsorted(percent * self.sizes, 100 * self.sizes, side="right")
        self._folded: dict[int, np.ndarray] = {}

    def _table(self, length: int) -> np.ndarray:
        """All sketches of at least that length, with so many ranges."""
        if length not in self._folded:
            table = np.zeros((len(self.sketches), length), np.int32)
            for own in np.unique(self.lengths[self.lengths >= length]):
                at = np.flatnonzero(self.lengths == own)
                table[at] = np.stack([self.sketches[i] for i in at]).reshape(len(at), length, -1).sum(axis=2, dtype=np.int32)
            self._folded[length] = table
        return self._folded[length]

    def allow(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether document ``i`` may be linked with each of ``others``; a shorter or empty sketch says nothing."""
        length = int(self.lengths[i])
        if not length:
            return np.ones(len(others), bool)
        table = self._table(length)
        bound = np.minimum(table[others], table[i]).sum(axis=1)
        need = -(-self.percent * (self.sizes[i] + self.sizes[others]) // (100 + self.percent))
        return (bound >= need) | (self.lengths[others] < length)


def _families(percent: int):
    """Task over ``(lead, token, block, other, side, doc_id, n, root, sketch)``, groups (the first four) together.

    Joins components that have documents whose sizes and sketches allow a link,
    directly or through others: edges ``(a, b)`` of component roots, at most one
    per component and leading document, not one per pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead, rows, edges = None, None, [], []
        parent: dict[int, int] = {}
        apart: set[tuple[int, int]] = set()

        def find(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def close() -> None:
            rows.sort(key=lambda r: (r[2], r[1]))
            if len(rows) >= _FEW:
                close_many()
                return
            for i, (side, doc, n, root, own) in enumerate(rows):
                for side2, doc2, m, root2, other in rows[i + 1 :]:
                    if percent * m > 100 * n:
                        break
                    if root2 == root or (side == side2 and side != 2) or find(root) == find(root2):
                        continue
                    if (doc, doc2) in apart:
                        continue
                    if overlap_bound(own, other) >= needed_overlap(n, m, percent):
                        parent[find(root)] = find(root2)
                        edges.append((root, root2))
                    else:
                        apart.add((doc, doc2))

        def close_many() -> None:
            tops: dict[int, int] = {}
            comp = np.array([tops.setdefault(find(r[3]), len(tops)) for r in rows])
            if len(tops) < 2:
                return
            sides = np.array([r[0] for r in rows])
            group = _Sketches([r[2] for r in rows], [r[4] for r in rows], percent)
            for i, row in enumerate(rows):
                others = np.arange(i + 1, group.ends[i])
                others = others[(comp[others] != comp[i]) & ((sides[others] != row[0]) | (row[0] == 2))]
                if not len(others):
                    continue
                others = others[group.allow(i, others)]
                for j in others[np.unique(comp[others], return_index=True)[1]]:
                    parent[find(row[3])] = find(rows[j][3])
                    edges.append((row[3], rows[j][3]))
                    comp[comp == comp[j]] = comp[i]

        def out() -> pa.RecordBatch:
            a, b = [e[0] for e in edges], [e[1] for e in edges]
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if row[:4] != group:
                    close()
                    rows = []
                    if row[0] != lead:
                        parent.clear()
                        apart.clear()
                    elif len(apart) >= 200_000:
                        apart.clear()
                    group, lead = row[:4], row[0]
                rows.append((*row[4:8], np.frombuffer(row[8], np.uint8)))
            if edges:
                yield out()
        close()
        yield out()

    return run


def _alike(percent: int):
    """Task over ``(lead, token, block, other, side, doc_id, n, sketch)``, groups (the first four) together.

    Keeps ``(token, doc_id, n)`` of documents that some other document of the
    n-gram may be linked with, by sizes and sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead, rows, kept = None, None, [], []
        known: dict[tuple[int, int], bool] = {}

        def close() -> None:
            rows.sort(key=lambda r: (r[2], r[1]))
            if len(rows) >= _FEW:
                close_many()
                return
            good = [False] * len(rows)
            for i, (side, doc, n, own) in enumerate(rows):
                for j in range(i + 1, len(rows)):
                    side2, doc2, m, other = rows[j]
                    if percent * m > 100 * n:
                        break
                    if (good[i] and good[j]) or (side == side2 and side != 2):
                        continue
                    key = (doc, doc2)
                    if key not in known:
                        known[key] = overlap_bound(own, other) >= needed_overlap(n, m, percent)
                    if known[key]:
                        good[i] = good[j] = True
            kept.extend((group[1], r[1], r[2]) for r, ok in zip(rows, good, strict=True) if ok)

        def close_many() -> None:
            sides = np.array([r[0] for r in rows])
            sketches = _Sketches([r[2] for r in rows], [r[3] for r in rows], percent)
            good = np.zeros(len(rows), bool)
            for i, row in enumerate(rows):
                others = np.arange(i + 1, sketches.ends[i])
                others = others[(sides[others] != row[0]) | (row[0] == 2)]
                if good[i]:
                    others = others[~good[others]]
                if len(others) and len(others := others[sketches.allow(i, others)]):
                    good[i] = good[others] = True
            kept.extend((group[1], rows[i][1], rows[i][2]) for i in np.flatnonzero(good).tolist())

        def out() -> pa.RecordBatch:
            cols = list(zip(*kept, strict=True)) or [[]] * 3
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["token", "doc_id", "n"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if row[:4] != group:
                    close()
                    rows = []
                    if row[0] != lead or len(known) >= 200_000:
                        known.clear()
                    group, lead = row[:4], row[0]
                rows.append((*row[4:7], np.frombuffer(row[7], np.uint8)))
            if kept:
                yield out()
        close()
        yield out()

    return run


def _led(t: DataFrame, sketches: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``token, doc_id, n, lead, k`` with sketches, those of one leading document together, in even parts."""
    led = t.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_LEAD).alias("parts"))
    # A document that leads very many rows has its n-grams dealt into parts, a large group its pairs of blocks.
    rows = t.join(led, "lead").withColumn("part", F.pmod(F.xxhash64("token"), F.col("parts"))).withColumn("blocks", F.ceil(F.col("k") / BLOCK_SETS).cast("int"))
    rows = _dealt(rows).join(sketches, "doc_id").select("lead", "token", "block", "other", "side", *columns, "sketch", "part")
    return rows.repartition("lead", "part", "block", "other").sortWithinPartitions("lead", "part", "block", "other", "token")


def _family_edges(t: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges between components that may be linked, enough to join all that may.

    ``t`` has ``token, doc_id, n, root, lead, k``, with all documents of an n-gram.
    """
    return _led(t, sketches, ["doc_id", "n", "root"]).mapInArrow(_families(percent), "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Deal the documents of groups of ``blocks`` blocks into all pairs of blocks: adds ``block, other, side``.

    ``side`` is 0 or 1 in a pair of two blocks, 2 where a block meets itself.
    """
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    return rows.withColumn("block", F.least("b", "o")).withColumn("other", F.greatest("b", "o")).withColumn("side", side)


def _block_links(width: int, percent: int, shared):
    """Task over ``(family, block, other, side, doc_id, n, root, prefix, text)``, blocks together: verified links.

    Counts the prefix n-grams every two documents share. Pairs of different
    components that share enough to be linked are looked up in the tree of the
    block, unless links that were found join them by then.
    """

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len({r[3] for r in rows}) < 2:
            return
        stored = [r for r in rows if r[0] != 1]
        if not stored:
            return
        parent = {r[3]: r[3] for r in rows}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        docs, sizes = np.array([r[1] for r in stored], np.int64), np.array([r[2] for r in stored], np.int64)
        behind = np.array([m - prefix_length(m, percent) for m in sizes.tolist()], np.int64)
        flat = np.concatenate([r[4] for r in stored])
        owner = np.repeat(np.arange(len(stored)), [len(r[4]) for r in stored])
        order = np.argsort(flat, kind="stable")
        flat, owner, tree = flat[order], owner[order], None
        for side, doc, n, root, prefix, keys in rows:
            if side == 0:
                continue
            lo, hi = np.searchsorted(flat, prefix), np.searchsorted(flat, prefix, side="right")
            k = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            common = np.bincount(owner[at], minlength=len(stored))
            # As shared_prefix_needed, for all at once.
            need = -(-percent * (n + sizes) // (100 + percent)) - np.maximum(behind, n - prefix_length(n, percent))
            among = (common >= np.maximum(need, 1)) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes))
            if side == 2:
                # Within a block every pair is met twice, and looked at once.
                among &= docs < doc
            for j in np.flatnonzero(among):
                among[j] = find(stored[j][3]) != find(root)
            if not among.any():
                continue
            tree = tree or PrefixTree([r[5] for r in stored])
            for j in tree.search(keys, percent, among):
                a, b = find(root), find(stored[j][3])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield doc, stored[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        group, rows, links = None, [], []

        def out() -> pa.RecordBatch:
            a, b = [x[0] for x in links], [x[1] for x in links]
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            prefixes = batch.column(7)
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True))
            for first, _, data, offsets in text_blocks(batch):
                for k, s in enumerate(_sets(data, offsets, width), first):
                    if keys[k][:3] != group:
                        links.extend(solve(rows))
                        group, rows = keys[k][:3], []
                    rows.append((*keys[k][3:], np.sort(prefixes[k].values.to_numpy()), _ordered(s, hot)))
            if links:
                yield out()
        links.extend(solve(rows))
        yield out()

    return run


def _family_links(prefixes: DataFrame, texts: DataFrame, percent: int, run) -> DataFrame:
    """Links within the families of ``prefixes(family, doc_id, n, root, prefix)``, verified in pairs of blocks.

    A text is shuffled once per pair of blocks, so a family of ``m`` documents moves ``m / BLOCK_SETS`` times its texts.
    """
    split = prefixes.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    rows = prefixes.join(split.select("family", F.ceil(F.col("m") / BLOCK_SETS).cast("int").alias("blocks")), "family")
    rows = _dealt(rows.join(texts, "doc_id")).select("family", "block", "other", "side", "doc_id", "n", "root", "prefix", "text")
    rows = rows.repartition("family", "block", "other").sortWithinPartitions("family", "block", "other")
    return rows.mapInArrow(run, "a long, b long")


def _enough(n: str, m: str, percent: int, share: float = 1.0):
    """Column: ``c`` is at least ``share`` of :func:`shared_prefix_needed` of two sizes."""
    overlap = F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / (100 + percent))
    behind = F.ceil(F.lit(percent) * F.greatest(n, m) / 100) - 1
    return F.col("c") >= F.greatest(F.lit(1), (overlap - behind) * share)


def _verify(pairs: DataFrame, texts: DataFrame, run) -> DataFrame:
    """Links among ``pairs(g1, lead_root, doc_id, root)``: each ``g1`` is looked up in the trees of its partners.

    Partners of one document are dealt into chunks of ``BLOCK_SETS``.
    """
    sizes = pairs.groupBy("g1").agg(F.count(F.lit(1)).alias("m"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_SETS)))
    members = pairs.join(sizes, "g1").withColumn("g2", chunk).withColumn("g3", F.lit(0))
    groups = members.select("g1", "g2", "g3", F.lit(0).alias("probe"), "doc_id", "root")
    leaders = members.select("g1", "g2", "g3", F.lit(1).alias("probe"), F.col("g1").alias("doc_id"), F.col("lead_root").alias("root")).distinct()
    # Only the texts that are looked at are shuffled.
    ids = pairs.select("doc_id").unionByName(pairs.select(F.col("g1").alias("doc_id"))).distinct()
    if ids.count() <= MAX_BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    rows = groups.unionByName(leaders).join(texts, "doc_id").select("g1", "g2", "g3", "probe", "doc_id", "root", "text")
    rows = rows.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "probe", "doc_id")
    return rows.mapInArrow(run, "a long, b long")


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents linked by n-gram Jaccard similarity of at least ``percent``.

    Takes ``doc_id, text`` (other columns are ignored); returns ``doc_id,
    n_shingles, component_id`` with the smallest reachable id.

    Edge cases: a text with fewer than ``width`` words is one n-gram; one
    without words, or null, has an empty set and is linked with nothing. Rows
    repeated under one id are one document if their sets are equal, and are
    otherwise linked through their id. Null ids are left alone: each such
    row is its own component, null. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(rows.mapInArrow(_set_rows(width), "kind int, id long, n long, h1 long, h2 long, sketch binary"), "ngram-sets")
    sets = first.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "h1", "h2", "sketch")
    hot = _frequent(first)
    shared = spark.sparkContext.broadcast(hot)

    filled = sets.filter("n_shingles > 0 and doc_id is not null")
    same = written(filled.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")).join(filled, ["h1", "h2", "n_shingles"]).select("doc_id", "rep"), "ngram-same")

    window = Window.partitionBy("token")
    prefixes = rows.filter("doc_id is not null").mapInArrow(_prefix_rows(width, percent, shared), "token long, doc_id long, n int")
    tokens = prefixes.withColumn("k", F.count(F.lit(1)).over(window)).filter("k > 1").select("token", "doc_id", "n")
    tokens = tokens.join(same, "doc_id").select("token", F.col("rep").alias("doc_id"), "n").distinct()
    drop_shuffles(spark)
    tokens = written(_grouped(tokens, window), "ngram-tokens", even=False)
    drop_shuffles(spark)
    # Most shared prefix n-grams are chance; rows without any partner alike enough end here.
    # Rows of one id with different texts have no common sketch; an empty one allows everything.
    one = F.when(F.min("sketch") == F.max("sketch"), F.min("sketch")).otherwise(F.lit(b""))
    sketches = sets.filter("doc_id is not null").groupBy("doc_id").agg(one.alias("sketch"))
    alike = _led(tokens, sketches, ["doc_id", "n"]).mapInArrow(_alike(percent), "token long, doc_id long, n int").distinct()
    tokens = written(_grouped(alike, window), "ngram-alike", even=False)
    drop_shuffles(spark)

    wanted = written(tokens.select("doc_id").distinct(), "ngram-wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS
    texts = written(rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), "ngram-texts", even=False)
    sketches = written(sketches.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), "ngram-sketches")

    links = written(same.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ngram-links")
    run = _linked(width, percent, shared)
    roots = None

    def rooted(df: DataFrame, key: str = "doc_id", name: str = "root") -> DataFrame:
        if roots is None:
            return df.withColumn(name, F.col(key))
        return df.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    for turn in range(LEADER_ROUNDS):
        t = _several_roots(rooted(tokens), window)
        order = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
        lead = F.first(F.struct("doc_id", "n", "root")).over(window.orderBy(order))
        pairs = t.drop("lead").withColumn("lead", lead).filter("root <> lead.root and 100 * least(n, lead.n) >= %d * greatest(n, lead.n)" % percent)
        pairs = pairs.groupBy(F.col("lead.doc_id").alias("g1"), F.col("lead.root").alias("lead_root"), F.col("lead.n").alias("n1"), "doc_id", "root", "n").agg(F.count(F.lit(1)).alias("c"))
        # A leader leads only some of the n-grams it shares; half of what is needed is worth a look, the rest comes later.
        pairs = written(pairs.filter(_enough("n1", "n", percent, 0.5)).select("g1", "lead_root", "doc_id", "root"), f"ngram-pairs{turn}")
        if not pairs.isEmpty():
            links = links.unionByName(written(_verify(pairs, texts, run), f"ngram-found{turn}"))
            roots = connected_components(links, "ngram-roots")
        elif roots is None:
            roots = connected_components(links, "ngram-roots")
    edges = written(_family_edges(_several_roots(rooted(tokens), window), sketches, percent), "ngram-maybe")
    if not edges.isEmpty():
        # Components that may be linked, directly or through others, are one family.
        family = connected_components(edges, "ngram-families").select(F.col("node").alias("root"), F.col("root").alias("family"))
        prefix = rooted(tokens).join(family, "root").groupBy("family", "doc_id", "n", "root").agg(F.collect_list("token").alias("prefix"))
        families = written(prefix, "ngram-prefixes")
        drop_shuffles(spark)
        found = written(_family_links(families, texts, percent, _block_links(width, percent, shared)), "ngram-linked")
        if not found.isEmpty():
            roots = connected_components(links.unionByName(found), "ngram-roots")
    out = sets.join(roots, sets["doc_id"] == roots["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _frequent(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``MAX_FREQUENT`` n-grams with the largest counts, and their places; counts that are alike all go or all stay."""
    total = first.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    counts = written(first.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")), "ngram-frequent")
    # As many n-grams at most have this count.
    most = max(_COUNT_APART, total // MAX_FREQUENT + 1)
    least, n = most, 0
    for row in sorted(counts.groupBy(F.least("n", F.lit(most)).alias("n")).count().collect(), reverse=True):
        n += row["count"]
        if n > MAX_FREQUENT:
            break
        least = row["n"]
    rows = counts.filter(F.col("n") >= least).toPandas()
    return _places(np.asarray(rows["id"], np.int64), np.asarray(rows["n"], np.int64))


def _grouped(t: DataFrame, window) -> DataFrame:
    """Rows ``token, doc_id, n`` of n-grams of several documents, with their number ``k`` and smallest id ``lead``."""
    return t.withColumn("k", F.count(F.lit(1)).over(window)).withColumn("lead", F.min("doc_id").over(window)).filter("k > 1")


def _several_roots(t: DataFrame, window) -> DataFrame:
    """The n-grams whose documents lie in more than one component, with all their rows."""
    t = t.withColumn("lo", F.min("root").over(window)).withColumn("hi", F.max("root").over(window))
    return t.filter("lo <> hi").drop("lo", "hi")
