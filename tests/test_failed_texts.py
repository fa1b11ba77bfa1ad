"""Texts that a plug-in cannot encode are an error, for a normalizer that Spark cannot run."""

import json

import pytest

from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.plans.jobs import count_token_frequencies
from tokscope.session import FIXTURE_TOKENIZER


def test_failed_texts_are_an_error(spark, tmp_path, monkeypatch):
    class Failing:
        def encode_batch(self, texts):
            return [None if "bad" in t else [1] for t in texts]

    conf = json.loads(open(FIXTURE_TOKENIZER, encoding="utf-8").read())
    conf["normalizer"] = {"type": "Precompiled", "precompiled_charsmap": ""}
    path = tmp_path / "normalized.json"
    path.write_text(json.dumps(conf), encoding="utf-8")
    monkeypatch.setattr(SparkTokenizer, "library_encoder", lambda self, add_special_tokens=False: Failing())
    docs = spark.createDataFrame([("good",), ("bad",)], "text string")
    with pytest.raises(RuntimeError, match="1 of 2 texts"):
        count_token_frequencies(spark, docs, str(path), str(tmp_path / "f"))
