"""The pipeline against plain Python, stage by stage on what each stage was given."""

import corpus_pipeline as P
from tests.llm.conftest import SF
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_packing import check, reference_ids


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    columns, kept = docs.columns, [texts(docs)]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            kept.append(texts(docs))
            assert docs.filter("n_chars <> length(text)").count() == 0
    raw, good, cleaned, single, clean = kept
    clean_ids = [i for i, v in labels.items() if v == (1, 0)]
    assert sum(i in good for i in clean_ids) >= 0.98 * len(clean_ids) and len(good) < len(raw)
    want = lines(good)
    assert set(cleaned) == set(good) and {i for i in good if cleaned[i] != good[i]} == {i for i, v in want.items() if v[1]}
    near = groups(cleaned, P.NEAR_WIDTH, P.NEAR_PERCENT)
    assert set(single) == {i for i, (_, c) in near.items() if c == i}
    assert set(clean) == set(single) - {d for d, _ in leaks(single, items)}
    ids = dict(zip(clean, reference_ids(list(clean.values())), strict=True))
    n = check(docs.collect(), ids, 1024)
    assert P.run(spark, SF).select("sequence_id").distinct().count() == n


def test_odd_rows_in_every_stage(spark, odd, empty):
    """Nulls, empty texts, repeated rows, columns named like results, an empty table."""
    named = {"n_lines": "'a'", "n_dropped": "'b'", "kept": "'c'", "model": "'d'", "threshold": "1", "n_chars": "cast(length(text) as long)", "source": "'s'"}
    table = odd.selectExpr("*", *(f"{v} as {k}" for k, v in named.items()))
    for name, stage in P.STAGES:
        if name == "packing":
            continue
        out = stage(spark, table, SF)
        rows = out.collect()
        assert out.columns == table.columns, name
        assert sum(r.doc_id == 5 for r in rows) == 2 and all(r.n_lines == "a" and r.n_dropped == "b" for r in rows), name
        assert stage(spark, table.limit(0), SF).count() == 0, name
    assert P.packing(spark, table, SF).filter("doc_id = 5").select("sequence_id", "offset").distinct().count() == 2
