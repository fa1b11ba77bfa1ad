"""P10, B1-B5 and the distributed ordinal."""

from pyspark.sql import functions as F

from tokscope.operators.batching import batch_by_chars, batch_by_count, batch_docs_newline, batch_lines, chunk_fixed, flatten
from tokscope.operators.ordinal import with_ordinal


def _docs(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_batch_by_chars_threshold(spark):
    packs = batch_by_chars(_docs(spark, ["aaa", "bbb", "ccc", "ddd"]), threshold=5).orderBy("pack_no").collect()
    assert [(p.pack_no, p.n_docs, p.text) for p in packs] == [(0, 2, "aaa bbb"), (1, 2, "ccc ddd")]


def test_batch_by_chars_remainder_and_grouping(spark):
    packs = batch_by_chars(_docs(spark, ["a" * 7, "b", "c", "d" * 10, "e"]), threshold=5, packs_per_batch=2)
    got = [(p.pack_no, p.batch_no, p.text) for p in packs.orderBy("pack_no").collect()]
    assert got == [(0, 0, "aaaaaaa"), (1, 0, "b c dddddddddd"), (2, 1, "e")]


def test_batch_by_count_skips_empty(spark):
    df = _docs(spark, ["a", "", "b", None, "c"])
    got = [(b.batch_no, b.n_docs, b.text) for b in batch_by_count(df, 2).orderBy("batch_no").collect()]
    assert got == [(0, 2, "a b"), (1, 1, "c")]


def test_batch_lines_and_newline(spark):
    df = _docs(spark, ["x", "y", "z"])
    assert [tuple(r.texts) for r in batch_lines(df, 2, order_col="doc_id").orderBy("batch_no").collect()] == [("x", "y"), ("z",)]
    assert [r.text for r in batch_docs_newline(df, 5).collect()] == ["x\ny\nz"]


def test_chunk_fixed(spark):
    df = _docs(spark, ["abcdefg", "", "xy"])
    got = sorted((r.doc_id, r.chunk_no, r.chunk) for r in chunk_fixed(df, 3).collect())
    assert got == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g"), (3, 0, "xy")]


def test_flatten(spark):
    df = spark.createDataFrame([([1, 2],), ([3],)], "ids array<int>")
    assert sorted(r.item for r in flatten(df, "ids").collect()) == [1, 2, 3]


def test_ordinal_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(6)
    got = sorted((r.ordinal, r.k) for r in with_ordinal(df, "k", name="ordinal", partitions=5).collect())
    assert [o for o, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_ordinal_ties_descending_and_hot_key(spark):
    # One value holds a third of the rows; ties are numbered by ``id``.
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("v"), "id")
    rows = with_ordinal(df.repartition(4), "v", ["id"], "o", descending=True, partitions=6).collect()
    got = [(r.v, r.id) for r in sorted(rows, key=lambda r: r.o)]
    assert got == sorted(((r.v, r.id) for r in rows), key=lambda t: (-t[0], t[1]))
    assert sorted(r.o for r in rows) == list(range(3000))


def test_ordinal_large_sparse_keys(spark):
    keys = [(1 << 62) + i * 1_000_003 for i in range(2000)] + [-(1 << 60), 0, 5]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = [r.k for r in sorted(with_ordinal(df, "k", partitions=7).collect(), key=lambda r: r.ordinal)]
    assert got == sorted(keys)


def test_batch_by_chars_many_segments_exact(spark):
    lengths = [(i * 7) % 5 + 1 for i in range(90)]
    df = _docs(spark, ["z" * n for n in lengths])
    got = [(p.n_docs, p.n_chars) for p in batch_by_chars(df, threshold=6, segment_docs=6).orderBy("pack_no").collect()]
    want, run, cur = [], 0, []
    for n in lengths:
        cur.append(n)
        run += n
        if run >= 6:
            want.append((len(cur), sum(cur)))
            cur, run = [], 0
    if cur:
        want.append((len(cur), sum(cur)))
    assert got == want  # 15 segments; packs cross segment boundaries


def test_ordinal_with_infinities_and_nulls(spark):
    vals = [float("inf"), 1.0, float("-inf"), None, 2.0, float("inf")] * 20
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    rows = with_ordinal(df, "v", ["i"], "o", partitions=4).collect()
    assert sorted(r.o for r in rows) == list(range(len(vals)))
    finite_first = [r.v for r in sorted(rows, key=lambda r: r.o)]
    assert finite_first[:20] == [float("-inf")] * 20 and finite_first[-20:] == [None] * 20
