"""Physical-plan properties of the registered queries (read from ``explain``)."""

import contextlib
import io
import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E

    from tokscope.plans.queries import QUERIES

    return {name: _plan(fn(spark, SF)) for name, fn in E.queries().items() if name in QUERIES}


def test_no_cross_products(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_documents_scan_is_pruned(plans):
    for name in ("pretoken_count", "token_frequency", "token_metrics", "batch_by_count"):
        schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plans[name])
        doc_scans = [s for s in schemas if "text" in s]
        assert doc_scans, name
        assert all("lang" not in s and "source" not in s and "n_chars" not in s for s in doc_scans), name
        assert "PushedFilters: [IsNotNull(text)]" in plans[name], name


def test_frequency_aggregates_combine_map_side(plans):
    tf = plans["token_frequency"]
    assert "partial_count" in tf and "partial_sum" in tf
    assert re.search(r"hashpartitioning\(piece", tf) and re.search(r"hashpartitioning\(token_id", tf)
    assert not re.search("EvalPython|InPandas|InArrow", tf)


def test_byte_match_plan(plans):
    tm = plans["neighbor_counts"]
    assert len(re.findall(r"ReadSchema: struct<[^\n]*text", tm)) == 1
    # Probe on a long hash key, bytes compared in the join condition.
    assert "Left keys [1]: [h#" in tm
    assert "SortMergeJoin" not in tm
    assert "partial_count" in tm
    assert re.search(r"hashpartitioning\(pid#\d+, left#\d+, right#\d+", tm)


def test_spread_only_when_needed(spark):
    from tokscope.plans.context import spread
    from tokscope.session import default_parallelism

    want = default_parallelism(spark)
    many = spark.range(0, 1000, numPartitions=want * 2)
    assert spread(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tokscope import session

    class Conf:
        def get(self, key, default=None):
            return default

    fake = SimpleNamespace(conf=Conf())
    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("yarn", True)):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        monkeypatch.setattr(session, "_context", lambda _s, sc=sc: sc)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(fake)


def test_broadcast_hint_stops_at_the_bound(spark):
    from tokscope.session import bounded_broadcast

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    rows = spark.range(100)
    assert hinted(bounded_broadcast(rows, 100)) and not hinted(bounded_broadcast(rows, 99))
    assert not hinted(bounded_broadcast(rows, 1_000, known_rows=10_000_000))


def test_ordinal_tells_many_buckets_apart(spark):
    from tokscope.operators.ordinal import split_points

    assert len(split_points(spark.range(0, 200_000).withColumnRenamed("id", "k"), "k", 5_000)) > 4_500
