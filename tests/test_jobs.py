"""The three end-to-end jobs on sf0.001 with the fixture vocabulary."""

import json

import pytest

from tokscope.functions.text import LATIN1_LETTER_RANGES
from tokscope.plans.jobs import count_token_frequencies, rank_script_tokens, score_vocabulary
from tokscope.session import FIXTURE_TOKENIZER

SF = "/root/testdata/sf0.001"


def test_three_jobs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    freq_path = str(tmp_path / "freq")
    top = count_token_frequencies(spark, docs, FIXTURE_TOKENIZER, freq_path).collect()
    assert len(top) == 20 and top[0]["count"] >= top[-1]["count"]
    obj = json.loads(spark.read.text(freq_path).first().value)
    assert sum(obj.values()) > 100_000 and list(obj.values()) == sorted(obj.values(), reverse=True)

    metrics = score_vocabulary(spark, docs, FIXTURE_TOKENIZER, str(tmp_path / "m.csv"), mode="text")
    assert metrics.count() == 500
    csv = spark.read.option("header", True).csv(str(tmp_path / "m.csv"))
    assert csv.columns == ["token", "freq_in_corpus", "standalone_ratio", "entropy", "length_bytes", "meaningless"]

    ranked = rank_script_tokens(spark, FIXTURE_TOKENIZER, freq_path, str(tmp_path / "rank"), LATIN1_LETTER_RANGES, mode="text")
    rows = ranked.collect()
    assert [r["rank"] for r in rows] == list(range(len(rows))) and len(rows) == 80
    ratios = [r.ratio for r in rows]
    assert ratios == sorted(ratios)
    include = json.loads(spark.read.text(str(tmp_path / "rank" / "include")).first().value)
    assert all(ids == sorted(ids) for ids in include.values())
    # The saved closure is reused on a second run.
    again = rank_script_tokens(spark, FIXTURE_TOKENIZER, freq_path, str(tmp_path / "rank"), LATIN1_LETTER_RANGES, mode="text")
    assert again.count() == len(rows)


def test_jobs_with_byte_level_vocabulary(spark, tmp_path):
    from tokscope.operators.encode import HFTokenizerEncoder
    from tokscope.operators.frequency import token_frequency_whole_text
    from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    freq_path = str(tmp_path / "freq")
    count_token_frequencies(spark, docs, FIXTURE_BYTE_LEVEL_TOKENIZER, freq_path)
    got = json.loads(spark.read.text(freq_path).first().value)
    with open(FIXTURE_BYTE_LEVEL_TOKENIZER, encoding="utf-8") as f:
        want = token_frequency_whole_text(docs, HFTokenizerEncoder.from_text(f.read()))
    assert {int(k): v for k, v in got.items()} == {r.token_id: r["count"] for r in want.collect()}
    m = score_vocabulary(spark, docs, FIXTURE_BYTE_LEVEL_TOKENIZER, str(tmp_path / "m"), mode="byte_level")
    rows = m.collect()
    assert len(rows) == 500
    partial = [r for r in rows if r.token == "�"]
    # Partial-byte tokens share the bytes EF BF BD, so they share one frequency (duplicate rows).
    assert partial and len({r.freq_in_corpus for r in partial}) == 1


def _small_tokenizer(path, merges):
    tokens = ["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)]
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}
    path.write_text(json.dumps({"model": model, "added_tokens": [], "normalizer": None, "pre_tokenizer": None}), encoding="utf-8")
    return str(path)


def test_closure_is_kept_per_tokenizer(spark, tmp_path):
    one = _small_tokenizer(tmp_path / "one.json", [("a", "b"), ("ab", "c")])
    two = _small_tokenizer(tmp_path / "two.json", [("b", "c"), ("a", "bc")])
    docs = spark.createDataFrame([("abcabca",), ("bcb",)], "text string")
    ranges = ((0x61, 0x7A),)
    got = {}
    for name, tok in (("one", one), ("two", two)):
        freq = str(tmp_path / f"freq-{name}")
        count_token_frequencies(spark, docs, tok, freq)
        for folder in ("shared", name):
            rows = rank_script_tokens(spark, tok, freq, str(tmp_path / folder), ranges, mode="text").collect()
            got[name, folder] = sorted((r.token, r.freq, r.descendant_freq) for r in rows)
    assert got["one", "shared"] == got["one", "one"] and got["two", "shared"] == got["two", "two"]
    assert got["one", "one"] != got["two", "two"]


def test_unresolved_merges_are_an_error(spark, tmp_path):
    path = tmp_path / "bad.json"
    good = json.loads(open(_small_tokenizer(tmp_path / "good.json", [("a", "b")])).read())
    good["model"]["merges"].append(["x", "y"])
    path.write_text(json.dumps(good))
    freq = tmp_path / "freq"
    freq.write_text("{}")
    with pytest.raises(ValueError, match="'x'\\+'y'"):
        rank_script_tokens(spark, str(path), str(freq), str(tmp_path / "out"))


def test_failed_texts_are_an_error(spark, tmp_path, monkeypatch):
    from tokscope.operators.tokenizer import SparkTokenizer

    class Failing:
        def encode_batch(self, texts):
            return [None if "bad" in t else [1] for t in texts]

    conf = json.loads(open(FIXTURE_TOKENIZER, encoding="utf-8").read())
    conf["normalizer"] = {"type": "NFC"}
    path = tmp_path / "normalized.json"
    path.write_text(json.dumps(conf), encoding="utf-8")
    monkeypatch.setattr(SparkTokenizer, "library_encoder", lambda self: Failing())
    docs = spark.createDataFrame([("good",), ("bad",)], "text string")
    with pytest.raises(RuntimeError, match="1 of 2 texts"):
        count_token_frequencies(spark, docs, str(path), str(tmp_path / "f"))
