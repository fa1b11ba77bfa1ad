"""Distinct sketches within their error, heavy hitters equal to a full count."""

import random
from collections import Counter

import pytest

from tokscope.operators.sketches import distinct_sketches, merged_distinct, relative_error, top_k_verified


def test_union_of_sketches_counts_overlaps_once(spark):
    rows = [(f"w{i}", part) for part in range(3) for i in range(part * 8000, part * 8000 + 20_000)] + [(None, 0)]
    df = spark.createDataFrame(rows, "w string, part int")
    sketches = distinct_sketches(df, "w", ["part"])
    assert sketches.count() == 3
    total = merged_distinct(sketches).first().n_distinct
    assert abs(total - 36_000) <= 5 * relative_error() * 36_000
    for r in merged_distinct(sketches, ["part"]).collect():
        assert abs(r.n_distinct - 20_000) <= 5 * relative_error() * 20_000
    assert merged_distinct(distinct_sketches(df.limit(0), "w", ["part"])).first().n_distinct == 0


@pytest.mark.parametrize("seed", range(3))
def test_top_k_is_exact(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7 + seed / 2))}" for _ in range(20_000)]
    df = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)] + [(None, 1)] * 500, "w string, part int")
    want = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:5]
    got = top_k_verified(df, "w", 5, ["part"], tracked=64)
    assert [tuple(r) for r in got.collect()] == want


def test_flat_counts_and_few_items_fall_back(spark):
    flat = spark.createDataFrame([(f"w{i}",) for i in range(3000) for _ in range(2)], "w string")
    tries = []
    got = top_k_verified(flat, "w", 4, tracked=64, max_tracked=512, tries=tries)
    assert [tuple(r) for r in got.collect()] == [(w, 2) for w in sorted(f"w{i}" for i in range(3000))[:4]]
    assert tries == [64, 512, None]
    few = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string")
    assert [tuple(r) for r in top_k_verified(few, "w", 4).collect()] == [("b", 2), ("a", 1)]
    assert top_k_verified(few.limit(0), "w", 4).count() == 0
