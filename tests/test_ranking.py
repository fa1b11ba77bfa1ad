"""J1, J4, A10, A11, R2, R3, R5."""

import pytest

from tokscope.operators.ranking import descendant_frequency, entropy_rank_curve, survival_ratio, zero_fill


def test_survival_ratio_cases(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (5, 0)], "freq long, descendant_freq long")
    assert [r[0] for r in df.select(survival_ratio()).collect()] == [-1e8, 0.0, 1.0]


def test_zero_fill_keeps_outside_ids(spark):
    vocab = spark.createDataFrame([(0,), (1,), (2,)], "token_id int")
    freq = spark.createDataFrame([(1, 4), (9, 2)], "token_id int, count long")
    got = sorted(tuple(r) for r in zero_fill(vocab, freq).collect())
    assert got == [(0, 0), (1, 4), (2, 0), (9, 2)]


def test_descendant_frequency(spark):
    closure = spark.createDataFrame([(0, 2), (1, 2), (0, 3)], "ancestor int, descendant int")
    filled = spark.createDataFrame([(0, 1), (1, 1), (2, 5), (3, 7)], "token_id int, freq long")
    got = {r.token_id: r.descendant_freq for r in descendant_frequency(closure, filled).collect()}
    assert got == {0: 12, 1: 5, 2: 0, 3: 0}


def test_entropy_rank_curve_dense(spark):
    vals = [0.5, 2.0, 2.0, 1.0, 0.0, 3.5] * 50
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "token_id int, entropy double").repartition(5)
    got = sorted((r.x, r.y) for r in entropy_rank_curve(df).collect())
    assert [x for x, _ in got] == list(range(len(vals)))
    assert [y for _, y in got] == sorted(vals, reverse=True)


def test_flagship_entry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"token_id", "token", "freq", "descendant_freq", "ratio", "rank"}
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r.ratio == pytest.approx(-1e8) or 0.0 <= r.ratio <= 1.0


def test_registry_has_oracle_for_every_query():
    import __spark_entry__ as E

    from tokscope.plans.queries import QUERIES

    # 50,000 merges are too many for the oracle's fold; tests compare that query with its library.
    assert set(QUERIES) - {"encode_gpt"} <= set(E.oracle_sql()) <= set(E.queries())
