import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SF
from tokscope.llm.common import mix64
from tokscope.llm.lang_id import identify, identify_languages, train
from tokscope.llm.queries import op7_language_id


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_scored_rows_is_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    blind = docs.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 'zz', lang)"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(blind).collect()}


def test_without_letters_or_model(spark, odd, empty):
    rows = spark.createDataFrame([(1, "123 !?"), (2, None), (3, ""), (4, "für die")], "doc_id long, text string")
    model = train(spark.createDataFrame([("für die Katze", "de"), ("for the cat", "en")], "text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in identify(rows, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "de"}
    assert {(r.lang_pred, r.score) for r in identify(rows, None).collect()} == {("und", 0.0)}
    assert identify_languages(odd).count() == odd.count()
    assert identify_languages(empty).count() == 0


def brute(train_rows, texts, buckets, orders=(1, 2, 3), smoothing=0.5):
    """Naive Bayes written out: one dictionary of n-gram buckets per language, scores by plain sums."""

    def grams(text):
        codes = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
        for order in orders:
            for i in range(len(codes) - order + 1):
                part = codes[i : i + order]
                if any(part):
                    acc = order
                    for c in part:
                        acc = (acc * 0x100000001B3 + c + 1) % (1 << 64)
                    yield int(mix64(np.array([acc], np.uint64))[0]) % buckets

    counts, docs = {}, Counter()
    for text, lang in train_rows:
        docs[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        mine = list(grams(text or ""))
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        scores = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + smoothing * buckets
            scores[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][b] + smoothing) / total) for b in mine)
        best = max(sorted(scores), key=lambda x: scores[x])
        out.append((best, 1 / sum(math.exp(v - scores[best]) for v in scores.values())))
    return out


@pytest.mark.parametrize("group", [2, 64])
def test_against_brute_force(spark, group):
    rnd = random.Random(group)
    names = ["aa", "bb", "cc", "dd", "ee"]
    rows = [("".join(rnd.choice("abcdefgh"[i : i + 5] + " é") for _ in range(30)), names[i % 4]) for i in range(4) for _ in range(6)] + [("zzzz", "ee"), ("", "aa")]
    texts = [r[0] for r in rows[::3]] + ["abc 1", None, "77", "É"]
    model = train(spark.createDataFrame(rows, "text string, lang string"), buckets=256, group=group)
    got = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for g, (lang, score) in zip(got, brute(rows, texts, 256), strict=True):
        assert g.lang_pred == lang and g.score == pytest.approx(score, rel=1e-3)


def test_a_thousand_languages(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(1000)]
    rows = [(i, t, f"l{i:04d}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    several = {r.doc_id: r for r in identify(docs, train(docs, buckets=1 << 12, group=300)).collect()}
    once = {r.doc_id: r for r in identify(docs, train(docs, buckets=1 << 12, group=1000)).collect()}
    assert len(several) == 1000 and sum(several[i].lang_pred == lang for i, _, lang in rows) >= 990
    assert {i: r.lang_pred for i, r in several.items()} == {i: r.lang_pred for i, r in once.items()}
    assert all(several[i].score == pytest.approx(once[i].score, rel=1e-9) for i in several)
