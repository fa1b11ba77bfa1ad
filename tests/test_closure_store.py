"""Incremental closure against the full one and an independent walk."""

import random

import pytest

from tokscope.operators.mergegraph import extend_closure, merge_closure
from tokscope.sinks.closure_store import ClosureStore

SCHEMA = "ancestor int, descendant int"


def walked(edges):
    after = {}
    for a, d in edges:
        after.setdefault(a, set()).add(d)
    out = set()
    for a in after:
        stack = list(after[a])
        while stack:
            d = stack.pop()
            if (a, d) not in out:
                out.add((a, d))
                stack += after.get(d, ())
    return out


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(4))
def test_extension_equals_full_closure(spark, seed):
    rnd = random.Random(seed)
    nodes = 25
    # The last seed allows cycles.
    edges = {(a, b) for a, b in ((rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(45)) if a < b or seed == 3}
    old = set(rnd.sample(sorted(edges), len(edges) // 2))
    closure = merge_closure(spark.createDataFrame(sorted(old), SCHEMA))
    new = spark.createDataFrame([*sorted(edges - old), *sorted(old)[:3], (None, 1)], SCHEMA)
    more = extend_closure(closure, new)
    assert pairs(more) == walked(edges) - walked(old)


def test_long_chain_needs_few_rounds(spark):
    closure = merge_closure(spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)], SCHEMA))
    more = extend_closure(closure, spark.createDataFrame([(i, i + 1) for i in range(1, 40, 2)], SCHEMA), max_rounds=8)
    assert pairs(more.union(closure)) == walked([(i, i + 1) for i in range(40)])


def test_store_appends_rebuilds_and_compacts(spark, tmp_path):
    store = ClosureStore(spark, str(tmp_path / "c"), compact_every=2)
    with pytest.raises(ValueError):
        store.pairs()
    assert pairs(store.update(spark.createDataFrame([], SCHEMA))) == set()
    edges = []
    for k, more in enumerate([[(1, 2), (3, 4), (1, 2), (None, 4)], [(2, 3)], [(0, 1)]]):
        edges += more
        got = pairs(store.update(spark.createDataFrame(edges, SCHEMA)))
        assert got == walked([e for e in edges if None not in e])
        assert store.state() == [(0, 2), (1, 1), (1, 2)][k]
    # Nothing new writes nothing; only new pairs are in the last delta.
    store.update(spark.createDataFrame(edges, SCHEMA))
    assert store.state() == (1, 2)
    assert pairs(spark.read.parquet(str(tmp_path / "c/gen=1/delta=1/pairs"))) == {(0, 1), (0, 2), (0, 3), (0, 4)}
    # A removed edge takes the pairs that it led to along.
    left = [(1, 2), (3, 4), (0, 1)]
    assert pairs(store.update(spark.createDataFrame(left, SCHEMA))) == walked(left)
    assert store.state() == (2, 1)


def test_interrupted_update_is_done_over(spark, tmp_path):
    store = ClosureStore(spark, str(tmp_path / "c"))
    store.update(spark.createDataFrame([(1, 2)], SCHEMA))
    # Edges written, pairs not: the delta does not count.
    spark.createDataFrame([(7, 8)], SCHEMA).write.parquet(str(tmp_path / "c/gen=0/delta=1/edges"))
    assert pairs(store.pairs()) == {(1, 2)}
    assert pairs(store.update(spark.createDataFrame([(1, 2), (2, 3)], SCHEMA))) == {(1, 2), (2, 3), (1, 3)}


def test_long_cycle_and_chain_end(spark):
    edges = [(i, (i + 1) % 40) for i in range(40)] + [(100 + i, 101 + i) for i in range(35)] + [(5, 100)]
    assert pairs(merge_closure(spark.createDataFrame(edges, SCHEMA))) == walked(edges)
    with pytest.raises(ValueError):
        merge_closure(spark.createDataFrame(edges, SCHEMA), max_rounds=3)


def test_a_pair_is_found_once_per_length_of_its_paths(spark, monkeypatch):
    """Before, a round found a pair once for each node between its ends, and joined all pairs again to see that none is new."""
    from tokscope.operators import mergegraph

    cut, made = mergegraph.cut_columns, []

    def counted(df):
        made.append(cut(df))
        return made[-1]

    monkeypatch.setattr(mergegraph, "cut_columns", counted)
    # Words letter by letter: the letters lead to very many nodes and nothing leads to them.
    words = ["".join(random.Random(i).choices("abc", k=12)) for i in range(40)]
    edges = sorted({(p, w[:i]) for w in words for i in range(2, 13) for p in (w[: i - 1], w[i - 1])})
    want = walked(edges)
    assert pairs(merge_closure(spark.createDataFrame(edges, "ancestor string, descendant string"))) == want
    # Edges, letters, each round's pairs of exact and of any length, and the closure.
    assert sum(df.count() for df in made) < 3.2 * len(want)
