import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import SF
from tokscope.llm import suffix_dedup
from tokscope.llm.queries import op9_suffix_dedup
from tokscope.llm.suffix_dedup import expand_intervals, remove_repeats, suffix_order


def brute(docs, length):
    seen, out = set(), {}
    for i in sorted(docs):
        data = docs[i].encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def digest(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_registered_query(spark, docs):
    assert digest(op9_suffix_dedup(spark, SF).collect()) == brute(docs, 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pasted_passages(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé \n") for _ in range(rng.randrange(60, 260))) for _ in range(8)]
    pool += ["ab" * 150, " " * 130, "x" * 99]
    docs = {}
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("defgh") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(6))]
        docs[i] = "".join(p[rng.randrange(20) :] for p in parts)
    got = digest(remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 100).collect())
    assert got == brute(docs, 100)


def test_blocks_cut_in_pieces_give_the_same_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 700, 700, 760, 3000, 5000])

    def windows():
        row, start, size, pos, anchor, _ = suffix_dedup.segments(data, offsets, 100)
        return sorted((int(s) + k, int(r), int(a)) for r, s, n, a in zip(row, start, size, anchor, strict=True) for k in range(int(n) - 99))

    whole = windows()
    assert [w[0] for w in whole] == [s for a, b in zip(offsets[:-1], offsets[1:], strict=True) for s in range(a, b - 99)]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 900)
    assert windows() == whole


@pytest.mark.parametrize("length", [1, 2, 5, 20])
def test_interval_expansion_equals_direct_comparison(length):
    rng = np.random.default_rng(length)
    for _ in range(25):
        parts = [[*rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)).tolist(), 0] for _ in range(6)]
        parts += [parts[0], parts[1][3:], parts[2][:-5] + [0]]
        text = np.array(sum(parts, []), np.int32)
        sa = suffix_order(text, length)
        assert sorted(sa.tolist()) == list(range(len(text)))
        heads = [tuple(text[i : i + length].tolist()) for i in sa]
        assert heads == sorted(heads)
        border, shared = expand_intervals(text, sa, length)
        whole = [i for i, h in enumerate(heads) if len(h) == length and 0 not in h]
        count = collections.Counter(heads[i] for i in whole)
        assert [bool(shared[i]) for i in whole] == [count[heads[i]] > 1 for i in whole]
        group = np.cumsum(border)
        again = [i for i in whole if shared[i]]
        for a, b in zip(again[:-1], again[1:], strict=True):
            assert (group[a] == group[b]) == (heads[a] == heads[b])


def test_kept_bytes(spark):
    p = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    out = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame([(1, "A" + p), (2, "B" + p + "C")], "doc_id long, text string")).collect()}
    assert out == {1: ("A" + p).encode(), 2: b"BC"}


def test_odd_rows(odd, empty):
    rows = remove_repeats(odd, with_kept=False).collect()
    assert len(rows) == odd.count()
    assert all(r.n_removed == 0 for r in rows if r.doc_id == 5) and {r.n_bytes for r in rows if r.doc_id in (1, 2, 6)} == {0}
    assert remove_repeats(empty).count() == 0
