"""Hard negatives by exact inner-product search over anchor-clustered shared lists.

Anchors are grouped by angle. In every block of candidate rows, each cluster
sorts the candidates once by an upper bound that holds for all of its members:
a candidate at angle t from the centroid of a cluster whose members lie within
angle r of it scores at most ``|anchor| * |candidate| * cos(max(0, t - r))``.
Each member walks that list in growing steps, scoring exactly in integers, and
stops where the bound certifies that no later candidate can enter its result.

Two scans of the rows per pass: the first finds each anchor's positives, the
second the negatives in the score range of each positive. Anchors are taken in
passes of bounded size, which are broadcast; rows are never shuffled, only the
few best of each task are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokscope.llm.common import python_tasks, written

SCALE = 256
#: Components of the anchors of one pass (8 bytes each in a task).
PASS_CELLS = 1 << 21
#: Largest scaled component that takes part: any inner product of 2^11 of them fits in 64 bits.
LARGEST = 1 << 26
#: Angle (radians) by which bounds are widened against rounding; far above the error of arccos in doubles.
SLACK = 1e-6
#: Candidates scored in the first and the longest step of a walk, and members that walk together.
FIRST_STEP, LAST_STEP, MEMBERS = 512, 4096, 512
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(column: pa.Array, scale: int, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as ``floor(scale * x)``, zero-padded to the longest, and which of them take part.

    A null list, a null or non-finite component or one beyond ``LARGEST`` excludes a row.
    """
    n = len(column)
    ok = np.asarray(column.is_valid())
    values = column.flatten().cast(pa.float64())
    size = np.where(ok, np.diff(column.offsets.to_numpy()), 0)
    whole = np.floor(scale * values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(n), size)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(whole) <= LARGEST)
    ok[row[bad]] = False
    whole[bad] = 0
    out = np.zeros((n, max(width, int(size.max(initial=0)))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = whole
    return out, ok


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of two matrices of whole numbers."""
    largest = float(np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0)))
    if largest < 2.0**52:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole number that a double holds
    return a.astype(np.int64) @ b.astype(np.int64).T


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=-1))
    return x / np.where(norm > 0, norm, 1)[..., None], norm


@dataclass
class Anchors:
    """The anchors of a pass, members of a cluster side by side."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    bounds: np.ndarray  # first member of each group, and the end
    centroids: np.ndarray  # of each group's cluster
    reach: np.ndarray  # largest angle of a member of it

    @classmethod
    def clustered(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rounds: int = 8) -> Anchors:
        """Spherical k-means with about the square root of the anchors as clusters, started from evenly spaced ids."""
        unit, norms = _unit(vectors)
        n = len(ids)
        k = max(1, int(np.sqrt(n)))
        centroids = unit[np.argsort(ids, kind="stable")[np.linspace(0, n - 1, k).astype(int)]]
        for _ in range(rounds):
            at = (unit @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, at, unit)
            fresh, size = _unit(sums)
            centroids = np.where(size[:, None] > 0, fresh, centroids)
        at = (unit @ centroids.T).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(k + 1))
        angle = np.arccos(np.clip((unit * centroids[at]).sum(axis=1), -1, 1))
        angle[(norms == 0) | ((centroids[at] ** 2).sum(axis=1) == 0)] = np.pi  # no direction: no angular bound
        reach = np.zeros(k)
        np.maximum.at(reach, at, angle)
        # A large cluster walks in several groups, so a step's scores stay small.
        cuts = [(c, a) for c in range(k) for a in range(bounds[c], bounds[c + 1], MEMBERS)]
        of, starts = np.array([c for c, _ in cuts]), np.array([a for _, a in cuts] + [n])
        return cls(ids[order], labels[order], vectors[order], norms[order], starts, centroids[of], reach[of])


class Best:
    """The first ``k`` candidates (higher score, then smaller id) of every target within its score range."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.need = low.copy()  # a candidate below cannot enter any more
        self.size = np.zeros(len(low), np.int64)
        self.score = np.zeros((len(low), k), np.int64)
        self.id = np.zeros((len(low), k), np.int64)

    def add(self, target: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(target):
            return
        touched = np.unique(target)
        old = np.repeat(touched, self.size[touched])
        slot = np.arange(len(old)) - np.searchsorted(old, old)
        t, s, i = np.concatenate([old, target]), np.concatenate([self.score[old, slot], score]), np.concatenate([self.id[old, slot], ids])
        by = np.lexsort((i, -s, t))
        t, s, i = t[by], s[by], i[by]
        nth = np.arange(len(t)) - np.searchsorted(t, t)
        t, s, i, nth = (x[nth < self.k] for x in (t, s, i, nth))
        self.score[t, nth], self.id[t, nth] = s, i
        self.size[touched] = np.bincount(np.searchsorted(touched, t), minlength=len(touched))
        full = touched[self.size[touched] == self.k]
        self.need[full] = np.maximum(self.low[full], self.score[full, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        target, slot = np.nonzero(np.arange(self.k) < self.size[:, None])
        return target, self.score[target, slot], self.id[target, slot]


def walk(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, best: Best, per_anchor: int, same_label: bool) -> int:
    """Let every anchor walk its cluster's list over one block; returns the scores computed.

    Anchor ``a`` has the targets ``a * per_anchor`` and on. With ``same_label``
    candidates are other rows of the anchor's label, else rows of other labels.
    """
    unit, norms = _unit(vectors)
    scored = 0
    for c in range(len(anchors.reach)):
        a, b = int(anchors.bounds[c]), int(anchors.bounds[c + 1])
        angle = np.arccos(np.clip(unit @ anchors.centroids[c], -1, 1))
        limit = norms * np.cos(np.maximum(angle - anchors.reach[c] - SLACK, 0))
        order = np.argsort(-limit, kind="stable")
        members = np.arange(a, b)
        at, step = 0, FIRST_STEP
        while at < len(order):
            need = best.need.reshape(-1, per_anchor)[members].min(axis=1)
            top = limit[order[at]] * anchors.norms[members]
            members = members[top + SLACK * np.abs(top) + SLACK >= need]
            if not len(members):
                break
            rows = order[at : at + step]
            scores = inner(anchors.vectors[members], vectors[rows])
            scored += scores.size
            match = labels[rows][None, :] == anchors.labels[members][:, None]
            fits = match & (ids[rows][None, :] != anchors.ids[members][:, None]) if same_label else ~match
            for j in range(per_anchor):
                target = members * per_anchor + j
                m, r = np.nonzero(fits & (scores >= best.need[target][:, None]) & (scores <= best.high[target][:, None]))
                best.add(target[m], scores[m, r], ids[rows[r]])
            at += step
            step = min(2 * step, LAST_STEP)
    return scored


def _walk_task(shared: Broadcast, scale: int, k: int, per_anchor: int, same_label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = shared.value
        best = Best(low.copy(), high, k)
        for batch in batches:
            vectors, ok = integer_vectors(batch.column(2), scale, anchors.vectors.shape[1])
            vectors = vectors[:, : anchors.vectors.shape[1]]  # beyond, all anchors are zero
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False)[ok] for i in (0, 1))
            if ok.any():
                walk(anchors, ids, labels, vectors[ok], best, per_anchor, same_label)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best.rows())), ["target", "score", "id"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each target over all tasks, in two steps so that one target's rows never meet in one group."""
    order = [F.desc("score"), F.asc("id")]
    split = found.withColumn("split", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = split.withColumn("rank", F.row_number().over(Window.partitionBy("target", "split").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*order))).filter(F.col("rank") <= k).drop("split")


_NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _one_pass(rows: DataFrame, chosen: pa.Table, scale: int, positives: int, negatives: int, low_percent: int) -> tuple[DataFrame, list[Broadcast]]:
    sc = rows.sparkSession.sparkContext
    vectors, ok = integer_vectors(chosen.column("vector").combine_chunks(), scale)
    ids, labels = (chosen.column(c).to_numpy()[ok] for c in ("id", "label"))
    if not len(ids):
        return rows.sparkSession.createDataFrame([], _NEGATIVES), []
    anchors = Anchors.clustered(ids, labels, vectors[ok])
    n, schema = len(anchors.ids), "target long, score long, id long"
    first = sc.broadcast((anchors, np.full(n, LOWEST), np.full(n, HIGHEST)))
    near = _first(rows.mapInArrow(_walk_task(first, scale, positives, 1, True), schema), positives).collect()  # at most `positives` rows an anchor
    first.destroy()
    score, of = np.full((n, positives), LOWEST), np.zeros((n, positives), np.int64)
    for r in near:
        score[r["target"], r["rank"] - 1], of[r["target"], r["rank"] - 1] = r["score"], r["id"]
    # The range low% * positive <= 100% * negative <= 100% * positive is empty for negative positives; a missing one asks for nothing.
    asks = score.ravel() >= 0
    whole = np.where(asks, score.ravel(), 0)
    low = np.where(asks, -(-low_percent * whole // 100), HIGHEST)
    second = sc.broadcast((anchors, low, np.where(asks, whole, LOWEST)))
    found = _first(rows.mapInArrow(_walk_task(second, scale, negatives, positives, False), schema), negatives)
    pairs = [(t, int(anchors.ids[t // positives]), int(of.ravel()[t]), int(whole[t])) for t in np.flatnonzero(asks).tolist()]
    names = rows.sparkSession.createDataFrame(pairs, "target long, anchor_id long, positive_id long, positive_score long")
    out = found.join(F.broadcast(names), "target")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), [second]


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    scale: int = SCALE,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    pass_cells: int = PASS_CELLS,
) -> DataFrame:
    """Hard negatives of the rows (``id, label, vector``) for which ``is_anchor`` holds.

    Scores are inner products of ``floor(scale * component)``. An anchor's
    positives are its first rows of the same label (higher score, then smaller
    id); per positive, the first rows of other labels that score at most as
    much as it and at least ``low_percent`` of it: ``anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score``. Other columns are
    ignored, whatever their names.

    Edge cases: rows with a null id, label or vector, with a null or non-finite
    component, or with a scaled component beyond 2^26 take no part. Shorter
    vectors are padded with zeros. Equal anchor rows count once; other repeated
    rows are candidates of their own, rows with an anchor's own id never its
    positives. A positive with a negative score has no negatives (the range is
    empty). No anchors or no rows: an empty result.
    """
    spark = rows.sparkSession
    python_tasks(spark)
    rows = rows.withColumn("_is_anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), "_is_anchor")
    rows = rows.filter("id is not null and label is not null and vector is not null")
    chosen = rows.filter("_is_anchor").select("id", "label", "vector").distinct()
    cells = chosen.agg(F.sum(F.size("vector") + 8)).first()[0] or 0
    passes = -(-cells // pass_cells) or 1
    of = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(passes))
    done = []
    for i in range(passes):
        # Equal rows are one here and the others are dealt by hash, so a pass holds about pass_cells components.
        result, used = _one_pass(rows.drop("_is_anchor"), chosen.filter(of == i).toArrow(), scale, positives, negatives, low_percent)
        if passes == 1:
            return result
        done.append(written(result, "hard-negatives"))
        for b in used:
            b.destroy()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
