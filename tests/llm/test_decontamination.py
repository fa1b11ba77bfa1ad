import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tokscope.llm import decontaminate
from tokscope.llm.decontaminate import BLOCKS, _Table, drop_contaminated, find_leaks
from tokscope.llm.queries import op10_decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]


def brute(docs, items, least=0.8):
    """All (document, item) with an item-sized window of weighted similarity ``least``, every window tried."""
    items = {i: words(t) for i, t in items.items() if words(t)}
    df = collections.Counter(s for w in items.values() for s in set(shingles(w)))
    weight = lambda s: 1 + math.log(len(items) / df.get(s, 1))
    out = {}
    for doc, text in docs.items():
        w = words(text)
        for item, iw in items.items():
            want = collections.Counter(shingles(iw))
            if len(w) < len(iw) or not set(shingles(w) if len(iw) >= 5 else map(tuple, zip(*(w[k:] for k in range(len(iw))), strict=False))) & set(want):
                continue
            for k in range(len(w) - len(iw) + 1):
                have = collections.Counter(shingles(w[k : k + len(iw)]))
                both = sum(min(n, want[s]) * weight(s) for s, n in have.items() if s in want)
                sim = both / (sum(n * weight(s) for s, n in have.items()) + sum(n * weight(s) for s, n in want.items()) - both)
                if sim >= least - 1e-12:
                    out[doc, item] = max(sim, out.get((doc, item), 0))
    return out


def test_registered_query(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.similarity for r in op10_decontamination(spark, SF).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_edited_passages(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(900)]
    items = {i: " ".join(rng.choice(vocab, rng.integers(2, 60))) for i in range(40)}
    items[40] = items[3]
    docs = {}
    for i in range(150):
        w = items[int(rng.integers(0, 41))].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = "changed"
        docs[i] = " ".join([*rng.choice(vocab, 30), *w, *rng.choice(vocab, 30)]).replace("w1", "W1").replace(" ", ", ", 3)
    make = lambda d, name: spark.createDataFrame(list(d.items()), f"{name} long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(make(docs, "doc_id"), make(items, "item_id")).collect()}
    assert not set(got) - set(want)
    assert len(got) >= 0.98 * len(want)  # the radius covers nearly all pairs at the threshold, and all close ones
    assert all(k in got for k, sim in want.items() if sim > 0.95)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    probes = prints[rng.integers(0, 60, 500)]
    for k in range(500):
        for bit in rng.choice(64, rng.integers(0, 22), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    for radius in (0, 7, 11, 19):
        w, i, d = _Table(prints, radius).lookup(probes)
        full = np.bitwise_count(probes[:, None] ^ prints[None, :])
        assert {(a, b) for a, b in zip(w.tolist(), i.tolist(), strict=True)} == {(int(a), int(b)) for a, b in np.argwhere(full <= radius)}
    assert BLOCKS == 4


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text twice same text"), (2, None), (3, ""), (None, "no id here"), (4, "twice")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in find_leaks(odd, items).collect())
    assert got == [(0, 0), (5, 1), (5, 1), (5, 4), (5, 4)]
    left = drop_contaminated(odd, items)
    assert left.columns == odd.columns and left.filter(F.col("doc_id") == 5).count() == 0 and left.count() == odd.count() - 3
    assert find_leaks(empty, items).count() == 0 and find_leaks(odd, items.limit(0)).count() == 0


def test_documents_shorter_than_the_item(spark):
    """A passage minus some words is one window, compared by exact similarity over the whole document."""
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(900)]
    items = {i: rng.choice(vocab, 60).tolist() for i in range(30)} | {30: ["one", "two", "three"], 31: rng.choice(vocab, 6).tolist()}
    docs = {}
    for i in range(30):
        for cut, off in ((1, 0), (2, 0), (2, 1), (8, 3), (20, 0)):
            docs[len(docs)] = items[i][off : off + 60 - cut]
    docs[len(docs)] = ["one", "two"]
    df = collections.Counter(s for w in items.values() for s in set(shingles(w)))
    weight = lambda s: 1 + math.log(len(items) / df.get(s, 1))
    want = {}
    for d, w in docs.items():
        for i, iw in items.items():
            if len(w) < len(iw):
                a, b = collections.Counter(shingles(w)), collections.Counter(shingles(iw))
                both = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
                sim = both / (sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - both)
                if sim >= 0.8:
                    want[d, i] = (sim, len(w))
    make = lambda d, name: spark.createDataFrame([(k, " ".join(w)) for k, w in d.items()], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in find_leaks(make(docs, "doc_id"), make(items, "item_id")).collect()}
    assert len(want) >= 120 and set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in got)
    assert all(k in got for k, (sim, _) in want.items() if sim > 0.95)
    assert drop_contaminated(make(docs, "doc_id"), make(items, "item_id")).count() == len(docs) - len({d for d, _ in got})


def test_several_passes_find_the_same_passages(spark, monkeypatch):
    # Distances are left out: each part weighs shingles by its own items.
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("found", F.lit("x"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    def leaks():
        return sorted(tuple(r)[:5] for r in find_leaks(docs, bench).collect())

    once = leaks()
    clean = sorted(map(tuple, drop_contaminated(docs, bench).collect()), key=repr)
    size = bench.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_CHARS", size // 3 + 1)
    assert once and leaks() == once
    assert sorted(map(tuple, drop_contaminated(docs, bench).collect()), key=repr) == clean
