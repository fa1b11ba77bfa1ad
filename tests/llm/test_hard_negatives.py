import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tokscope.llm.hard_negatives import Anchors, Best, integer_vectors, mine_hard_negatives, walk
from tokscope.llm.queries import op13_hard_negatives


def brute(rows, anchors, scale=256, positives=5, negatives=5):
    """By the definition, one pair at a time, for ``(id, label, vector)`` rows that take part."""
    whole = [(i, label, [math.floor(scale * float(x)) for x in v]) for i, label, v in rows]
    out = []
    for a, la, va in [r for r in whole if r[0] in anchors]:
        scores = [(sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in whole]
        first = sorted((-s, i) for s, i, label in scores if label == la and i != a)[:positives]
        for ps, p in first:
            fit = sorted((-s, i) for s, i, label in scores if label != la and 80 * -ps <= 100 * s <= 100 * -ps)[:negatives]
            out += [(a, p, r, n, -ps, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vector array<double>")


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    relabelled = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = sorted(tuple(r) for r in op13_hard_negatives(spark, SF).collect())
    assert got == brute(relabelled, {r.vec_id for r in rows if r.vec_id % 100 == 0}) and got


def test_ties_copies_and_passes(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 6))
    rows = [(i, int(rng.integers(0, 4)), (centers[i % 12] + 0.2 * rng.normal(size=6)).round(1).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 2, rows[5][2]) for i in range(40)]  # copies under two labels: ties at every rank
    df = frame(spark, rows).repartition(5)
    want = brute(rows, set(range(0, 1040, 20)))
    for options in ({}, {"pass_cells": 100}):
        got = sorted(tuple(r) for r in mine_hard_negatives(df, F.col("id") % 20 == 0, **options).collect())
        assert got == want and got


def test_walk_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    vectors = np.floor(256 * np.repeat(centers, 200, axis=0) * (1 + 0.02 * rng.normal(size=(4000, 16))))
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    anchors = Anchors.clustered(ids[::50], labels[::50], vectors[::50])
    low = np.full(len(anchors.ids), np.iinfo(np.int64).min)
    best = Best(low.copy(), np.full(len(low), np.iinfo(np.int64).max), 5)
    scored = walk(anchors, ids, labels, vectors, best, 1, True)
    assert scored < 0.5 * len(low) * 4000
    for a in range(len(low)):
        s = (vectors @ anchors.vectors[a]).astype(np.int64)
        fit = np.flatnonzero((labels == anchors.labels[a]) & (ids != anchors.ids[a]))
        want = sorted((-int(s[i]), int(i)) for i in fit)[:5]
        assert [(-x, y) for x, y in zip(best.score[a].tolist(), best.id[a].tolist())] == want


def test_large_components_are_exact(spark):
    big = 2.0**17
    rows = [(0, 1, [big, 3.0]), (1, 1, [big - 1, 1.0]), (2, 2, [big - 2, 5.0]), (3, 2, [big - 1, 1.0]), (4, 1, [2.0**40, 0.0]), (5, 1, [2.0**17, 2.0])]
    kept = [r for r in rows if r[0] != 4]  # beyond the documented limit
    got = sorted(tuple(r) for r in mine_hard_negatives(frame(spark, rows), F.col("id") == 0).collect())
    assert got == brute(kept, {0}) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 3, [float(i % 7) - 2, float(i % 5), 1.0]) for i in range(60)]
    bad = [(100, None, [1.0, 1.0, 1.0]), (200, 1, None), (300, 1, [1.0, None, 1.0]), (None, 1, [9.0, 9.0, 9.0]), (400, 2, [nan, 1.0, 1.0]), (500, 2, [1.0, inf, 1.0])]
    more = [(61, 1, [1.0]), (62, 2, [3.0, 3.0, 3.0, 3.0, 3.0]), (63, 0, [0.0, 0.0, 0.0]), (64, 1, [])]
    wide = lambda rows: [(i, x, (v + [0.0] * 5)[:5]) for i, x, v in rows]
    df = frame(spark, good + bad + more)
    for name in ("target", "score", "rank", "split", "_is_anchor", "anchor_id"):
        df = df.withColumn(name, F.lit("x"))
    anchors = set(range(0, 70, 10)) | {61, 63, 64}
    picked = (F.col("id") % 10 == 0) | F.col("id").isin(61, 63, 64)
    got = sorted(tuple(r) for r in mine_hard_negatives(df, picked).collect())
    assert got == brute(wide(good + more), anchors) and got
    twice = sorted(tuple(r) for r in mine_hard_negatives(df.unionByName(df.filter("id = 10")), picked).collect())
    doubled = wide([*good, *more, good[10]])
    assert twice == sorted(brute(doubled, anchors - {10}) + brute(wide(good + more), {10}))
    assert mine_hard_negatives(df.limit(0), picked).count() == 0 and mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert mine_hard_negatives(frame(spark, [(0, 1, [1.0])]), F.col("id") == 0).count() == 0


def test_integer_vectors_of_slices():
    import pyarrow as pa

    column = pa.array([[9.0], [0.5, -0.1], None, [1.0, None], [2.0]], pa.list_(pa.float64())).slice(1)
    whole, ok = integer_vectors(column, 256)
    assert ok.tolist() == [True, False, False, True] and whole[0].tolist() == [128, -26] and whole[3].tolist() == [512, 0]
