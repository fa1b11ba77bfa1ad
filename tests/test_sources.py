"""S1-S9 round trips and edge cases."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tokscope.sources.tables import (
    conversations_as_jsonl,
    corpus_from_jsonl_tree,
    line_count,
    load_frequencies,
    load_metrics,
    parse_conversation_lines,
    scan_bytes,
    scan_conversations,
    scan_table,
    scan_text,
)
from tokscope.sources.vocab import load_vocab

SF = "/root/testdata/sf0.001"


def test_conversation_lines(spark):
    lines = [
        '{"conversations":[{"role":"user","content":"hello"},{"content":"x"}]}',
        "bad{",
        "",
        '{"conversations":[]}',
        '{"conversations":[{"content":null}]}',
        '{"conversations":[{"content":5}]}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = parse_conversation_lines(df).collect()
    assert [r.content for r in got if r.ok] == ["hello"]
    assert sum(1 for r in got if not r.ok) == 5


def test_conversations_jsonl_round_trip(spark, tmp_path):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    path = str(tmp_path / "conv")
    conversations_as_jsonl(conv).write.text(path)
    got = {r.conv_id: r.content for r in scan_conversations(spark, path).collect()}
    first = {r.conv_id: r.text for r in conv.filter("turn = 0").collect()}
    assert got == first


def test_line_count(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\nb",), ("",)], "text string")
    assert line_count(df).first().n_lines == 3


RAW = b"a\r\nb\rc\n\xff\xfe bad\n\n" + b"x y z\n" * 60_000 + b"last"


def test_one_file_is_read_in_splits_with_every_byte(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_bytes(RAW)
    (tmp_path / "closed.txt").write_bytes(b"one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        rows = scan_bytes(spark, str(p)).collect()
        assert len({r.block for r in rows}) > 3
        assert b"".join(bytes(r.bytes) for r in sorted(rows, key=lambda r: (r.block, r.line))) == RAW
        both = scan_bytes(spark, str(tmp_path)).collect()
        assert sum(len(r.bytes) for r in both) == len(RAW) + 8
        seen = Observation("text")
        text = scan_text(spark, str(p), on_invalid="replace", observation=seen).collect()
        want = RAW.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        assert "".join(r.text for r in sorted(text, key=lambda r: (r.block, r.line))) == want
        assert seen.get["invalid"] == 1
        with pytest.raises(Exception, match="UTF-?8"):
            scan_text(spark, str(p)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_jsonl_tree(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = str(tmp_path / "tree")
    docs.select("text", "source").write.partitionBy("source").json(root)
    got = corpus_from_jsonl_tree(spark, root)
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in docs.select("text").collect())


def test_jsonl_tree_counts_bad_lines(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text('{"text":"one"}\nbad{\n{"other":1}\n{"text":5}\n{"text":""}\n{"text":null}\n')
    seen = Observation("tree")
    assert [r.text for r in corpus_from_jsonl_tree(spark, str(tmp_path), observation=seen).collect()] == ["one"]
    assert seen.get == {"rejected": 4, "empty": 1, "lines": 6}


def test_scan_table_column(spark):
    df = scan_table(spark, f"{SF}/documents.parquet", text_column="lang")
    assert df.columns == ["text"]


def test_load_frequencies_and_metrics(spark, tmp_path):
    p = tmp_path / "freq.json"
    p.write_text(json.dumps({"5": 10, "2": 3}))
    got = sorted(tuple(r) for r in load_frequencies(spark, str(p)).collect())
    assert got == [(2, 3), (5, 10)]
    m = tmp_path / "m.csv"
    m.write_text(
        "token,freq_in_corpus,standalone_ratio,entropy,length_bytes,meaningless\n"
        "a,3,0.5,1.25,1,false\nbroken,row\nb,0,0.0,0.0,1,true\n"
    )
    seen = Observation("metrics")
    rows = load_metrics(spark, str(m), seen).collect()
    assert seen.get == {"malformed": 1, "rows": 3}
    assert [(r.token, r.entropy) for r in rows] == [("a", 1.25), ("b", 0.0)]


def test_vocab_includes_added_tokens(spark):
    doc = '{"model":{"vocab":{"a":0,"b":1}},"added_tokens":[{"id":2,"content":"<s>","special":true}]}'
    tok = spark.createDataFrame([(doc,)], "value string").select(F.parse_json("value").alias("v"))
    got = sorted((r.token_id, r.token, r.special) for r in load_vocab(tok).collect())
    assert got == [(0, "a", False), (1, "b", False), (2, "<s>", True)]


def test_rejected_lines_observed(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"conversations":[{"content":"hi"}]}\nbad{\n\n{"conversations":[{"content":5}]}\n')
    kept, obs = scan_conversations(spark, str(p), observation=True)
    assert [r.content for r in kept.collect()] == ["hi"]
    assert obs.get["rejected"] == 3 and obs.get["lines"] == 4
