import collections
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import SF
from tokscope.llm.ngram_join import PrefixTree, needed_overlap, ngram_components, overlap_bound, prefix_length, shared_prefix_needed, sketch
from tokscope.llm.queries import op3_ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = collections.Counter()
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            shared.update((j, i) for j in holders[g])
            holders[g].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_registered_query(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_ngram_join(spark, SF).collect()}
    assert got == brute(docs, 4, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits(spark, seed):
    rng = random.Random(seed)
    docs, text = {}, []
    for i in range(160):
        if i % 40 == 0:
            text = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 90]))]
        copy = list(text if rng.random() < 0.5 else docs[rng.randrange(max(i - 5, 0), i)].split() if i else text)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
        docs[i] = " ".join(copy)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 3, 70).collect()}
    assert got == brute(docs, 3, 70)


def test_shared_passage_does_not_link(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = {i: f"{passage} " + " ".join(f"d{i}x{j}" for j in range(200)) for i in range(60)}
    out = ngram_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in out)


def test_tree_finds_all_and_only_similar_sets():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 80).astype(np.uint64))
    sets = []
    for _ in range(120):
        keep = base[rng.random(len(base)) < rng.choice([0.7, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])))
    sets += [sets[0], base[:1]]
    tree = PrefixTree(sets)
    for probe in [base, *sets[:20], base[:3]]:
        inter = [len(np.intersect1d(probe, s)) for s in sets]
        want = [i for i, s in enumerate(sets) if 100 * inter[i] >= 80 * (len(s) + len(probe) - inter[i])]
        assert sorted(tree.search(probe, 80)) == want
        for i, s in enumerate(sets):
            for other in (s, np.concatenate([s, s + np.uint64(1 << 62)]), s[:3]):
                shared = len(np.intersect1d(probe, other))
                assert overlap_bound(*(np.frombuffer(sketch(x), np.uint8) for x in (probe, other))) >= shared
        for i in want:
            a, b = probe[: prefix_length(len(probe), 80)], sets[i][: prefix_length(len(sets[i]), 80)]
            assert len(np.intersect1d(a, b)) >= shared_prefix_needed(len(probe), len(sets[i]), 80)


def test_needed_overlap():
    for n in range(1, 40):
        for m in range(1, 40):
            k = needed_overlap(n, m, 85)
            assert 100 * k >= 85 * (n + m - k) and 100 * (k - 1) < 85 * (n + m - k + 1)


def test_odd_rows(odd, empty):
    rows = ngram_components(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == r.doc_id for r in rows)
    assert {r.doc_id: r.n_shingles for r in rows}[1] == 0
    assert ngram_components(empty).count() == 0


def test_empty_sketches_bound_nothing():
    import numpy as np

    from tokscope.llm.ngram_join import overlap_bound

    none, some = np.zeros(0, np.uint8), np.ones(8, np.uint8)
    assert overlap_bound(none, none) == overlap_bound(none, some) == overlap_bound(some, none) == 1 << 62
    assert overlap_bound(some, some) == 8


def test_sketches_tell_unrelated_sets_of_any_size_apart():
    rng = np.random.default_rng(5)
    for n in (60, 100, 250, 700, 3000):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(40)]
        own = [np.frombuffer(sketch(s), np.uint8) for s in sets]
        # With 16 members a range one pair in fifty passed, and chance joined all short documents to one family.
        passed = sum(overlap_bound(own[i], own[j]) >= needed_overlap(len(sets[i]), len(sets[j]), 85) for i in range(40) for j in range(i))
        assert passed <= 2, n


def test_frequent_ngrams_come_last_by_their_counts():
    from tokscope.llm.ngram_join import _head, _ordered, _places

    hot = _places(np.array([30, 10, 20]), np.array([9, 2, 5]))
    values = np.array([5, 10, 20, 30, 40], np.uint64)
    top = 1 << 63
    assert _ordered(values, hot).tolist() == [5, 40, top, top | 1, top | 2]
    rng = np.random.default_rng(6)
    many = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    for share in (0, 3, 300, 400):
        hot = _places(rng.choice(many, share, replace=False).view(np.int64), rng.integers(2, 9, share))
        for k in (0, 1, 60, 399, 400):
            assert _head(many, hot, k).tolist() == _ordered(many, hot)[:k].tolist()


def test_many_sketches_compared_at_once():
    from tokscope.llm.ngram_join import _Sketches

    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64))
    sets = sorted((base[rng.random(len(base)) < p] for p in rng.choice([0.65, 0.8, 0.95, 1], 60)), key=len)
    own = [np.frombuffer(sketch(s), np.uint8) for s in sets]
    own[7] = own[40] = np.zeros(0, np.uint8)
    sizes = [len(s) for s in sets]
    group = _Sketches(sizes, own, 85)
    for i in range(60):
        assert group.ends[i] == sum(85 * m <= 100 * sizes[i] for m in sizes)
        others = np.arange(i + 1, 60)
        assert group.allow(i, others).tolist() == [overlap_bound(own[i], own[j]) >= needed_overlap(sizes[i], sizes[j], 85) for j in others]


def test_tree_walks_to_wanted_sets_only():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 62, 90).astype(np.uint64))
    sets = [base[rng.random(len(base)) < 0.93] for _ in range(60)]
    tree, among = PrefixTree(sets), rng.random(60) < 0.3
    every = tree.search(base, 85)
    assert every and sorted(tree.search(base, 85, among)) == sorted(i for i in every if among[i])
    assert tree.search(base, 85, np.zeros(60, bool)) == []


def test_family_of_near_alike_documents_moves_texts_by_block(spark, monkeypatch):
    """Before, a text was fetched and shuffled once for every pair that shares enough n-grams."""
    from tokscope.llm import ngram_join

    rng = random.Random(9)
    text = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(90):
        copy = list(text)
        for k in rng.sample(range(120), rng.choice([1, 4, 5, 6])):
            copy[k] = f"e{i}x{k}"
        docs[i] = " ".join(copy)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    moved, dealt = [], ngram_join._dealt

    def counted(rows):
        rows = dealt(rows)
        if "text" in rows.columns:
            moved.append(rows.count())
        return rows

    monkeypatch.setattr(ngram_join, "_dealt", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute(docs, 4, 85)
    assert moved and max(moved) <= 90 * -(-90 // 16)
