import collections
import math

import numpy as np

from tests.llm.conftest import SF
from tokscope.llm.lexical_search import TERM, BallTree, Corpus, Vocabulary, item_terms, search
from tokscope.llm.queries import op12_lexical_search

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """Scores of ``[(doc_id, text)]`` for ``[(item_id, text)]`` by the definition, one pair at a time."""
    tfs = [(d, collections.Counter(TERM.findall((t or "").translate(AZ)))) for d, t in docs]
    big_n = sum(1 for _, c in tfs if c)
    big_l = sum(c.total() for _, c in tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tfs:
            n, s = c.total(), 0
            for t in set(TERM.findall((text or "").translate(AZ))):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * n * big_n) // big_l)))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def make(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def test_registered_query(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in op12_lexical_search(spark, SF).collect()]
    assert key(got) == key(brute(list(docs.items()), items)) and len(got) == 10 * len(items)


def test_ties_copies_and_passes(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)] + ["Größe", "ÉTÉ", "x y", "日本"]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 30))).replace("w1", "W1") for _ in range(300)]
    docs = [(i, texts[i % 200 if i < 380 else 7]) for i in range(500)]  # a group of copies larger than k
    items = [(i, " ".join(rng.choice(vocab, 6))) for i in range(30)] + [(30, texts[7]), (31, "nothing of this"), (31, "w3 w4"), (32, "w3 w4")]
    want = key(brute(docs, items))
    frame = make(spark, docs, "doc_id").repartition(5)
    assert key(tuple(r) for r in search(frame, make(spark, items, "item_id")).collect()) == want
    many = search(frame, make(spark, items, "item_id"), pass_bytes=200)
    assert key(tuple(r) for r in many.collect()) == want


def test_tree_prunes_and_stays_exact():
    """Documents in clear groups: a search opens few leaves; the found equal a full scan, ties included."""
    rng = np.random.default_rng(5)
    width, rows = 400, []
    for g in range(40):
        base = rng.choice(width, 20, replace=False)
        for _ in range(60):
            rows.append({int(t): 10_000_000 + int(rng.integers(0, 3)) for t in rng.choice(base, 19, replace=False)})
    cols = np.concatenate([np.array(sorted(r), np.int64) for r in rows])
    values = np.concatenate([np.array([r[t] for t in sorted(r)], np.int64) for r in rows])
    tree = BallTree(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), cols, values, width)
    ids, opened = list(range(len(rows))), 0
    for q in range(0, len(rows), 97):
        terms = np.array(sorted(rows[q]), np.int64)
        best: list = []
        opened += tree.search(terms, best, ids, 10)
        full = sorted(((-sum(r.get(int(t), 0) for t in terms), i) for i, r in enumerate(rows)))[:10]
        assert sorted((-s, -d) for s, _, d in best) == full
    leaves = sum(1 for c in tree.children if c[0] < 0)
    assert opened < 0.5 * leaves * len(range(0, len(rows), 97))


def test_bounds_hold():
    rng = np.random.default_rng(9)
    rows = [rng.choice(50, 8, replace=False) for _ in range(300)]
    values = rng.integers(1, 1 << 35, 300 * 8)
    tree = BallTree(np.arange(301) * 8, np.concatenate(rows), values, 50)
    dense = np.zeros((300, 50), np.int64)
    dense[np.repeat(np.arange(300), 8), np.concatenate(rows)] = values
    for _ in range(50):
        terms = np.sort(rng.choice(50, 12, replace=False))
        norm = math.sqrt(12)
        bound = tree.centroids[:, terms].sum(axis=1) + norm * tree.radius + tree.error * norm * tree.spread
        for node, (a, b) in enumerate(tree.rows):
            assert dense[tree.order[a:b]][:, terms].sum(axis=1).max() <= bound[node]


def test_terms_and_large_counts():
    assert item_terms("A-b_c Ünï\x00x\x7f9 é") == {"a", "b", "c", "Ünï", "x", "9", "é"} and item_terms(None) == set()
    assert len(Vocabulary([])) == 0
    corpus = Corpus(10**11, 10**15, np.array([10**11]))
    n = np.array([10**8])
    entry = corpus.entries(n, np.array([0]), np.array([0]), np.array([3]), np.array([7]))
    assert entry[0] == 7 * (3_000_000_000 // (3000 + 8 * (10 + (90 * 10**8 * 10**11) // 10**15)))


def test_odd_rows(spark, odd, empty):
    items = [(1, "same text twice"), (2, None), (3, ""), (None, "no id here"), (4, "word7 and more word19999"), (4, "word7 and more word19999")]
    frame = make(spark, items, "item_id")
    want = key(brute([(r.doc_id, r.text) for r in odd.collect()], list(dict.fromkeys(items))))
    assert key(tuple(r) for r in search(odd.withColumnRenamed("h1", "score").withColumnRenamed("h2", "item"), frame).collect()) == want
    assert search(empty, frame).count() == 0 and search(odd, frame.limit(0)).count() == 0
