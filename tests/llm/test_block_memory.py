"""A scoring block holds a chunk of its texts at a time, and a written table of texts has small row groups."""

import glob
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tokscope.llm import common
from tokscope.llm import quality_lm as Q
from tokscope.session import ensure_checkpoint_dir


def test_texts_of_a_block_are_unpacked_chunk_by_chunk(monkeypatch):
    monkeypatch.setattr(Q, "CHUNK_CHARS", 10)
    texts = ["aaaa", None, "bbbb", "", "ccc", "d" * 25, "naïve", "e"]
    packed = pa.array([None if t is None else zlib.compress(t.encode(), 1) for t in texts], pa.binary())
    rows = np.array([7, 0, 1, 2, 3, 4, 5, 6])
    parts = list(Q._unpacked(packed, rows))
    assert [r.tolist() for r, _ in parts] == [[7, 0, 1, 2, 3], [4], [5], [6]]
    assert [t for _, some in parts for t in some] == [texts[i] or "" for i in rows]
    assert all(sum(map(len, some)) <= 10 or len(some) == 1 for _, some in parts)
    assert list(Q._unpacked(packed, rows[:0])) == []


def test_a_block_without_answers_scores_nothing():
    texts = ["one two", None]
    docs = pa.table({"row": [1, 2], "lang": ["x", "y"], "held": [True, False], "with_text": [True, True], "text": pa.array([t and zlib.compress(t.encode(), 1) for t in texts], pa.binary())})
    answers = pa.schema([("lang", pa.string()), ("key", pa.int64()), *[(c, pa.float32()) for c in ("p0", "b0", "p1", "b1")]]).empty_table()
    out = Q._score_block(docs, answers)
    assert out.column("text").to_pylist() == texts and out.column("n_scored").to_pylist() == [7, 0]
    assert out.column("bits").null_count == 2


def test_scores_with_texts_have_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "TEXT_GROUP_BYTES", 64 << 10)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/lm-scores-*"))
    docs = spark.range(1500).selectExpr("id as doc_id", "concat_ws(' ', sha2(string(id), 512), sha2(string(-id), 512), sha2(string(id + 0.5), 512)) as text", "'xx' as lang").coalesce(2)
    labels = spark.range(1500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    kept = {r.doc_id: r.text for r in Q.keep_good(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) > 1000 and all(texts[d] == t for d, t in kept.items())
    (path,) = set(glob.glob(f"{folder}/lm-scores-*")) - before
    groups = [meta.row_group(g) for f in glob.glob(f"{path}/*.parquet") for meta in [pq.ParquetFile(f).metadata] for g in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 1500
    assert max(g.total_byte_size for g in groups) < 160 << 10


def _block(n: int) -> tuple[pa.Table, pa.Table]:
    """About ``n`` times 8 KB of text, a block, and a model that has seen the letters alone."""
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (1300, 5))) for _ in range(40)]
    texts = [texts[i % 40] for i in range(n)]
    docs = pa.table({"row": range(n), "lang": ["x"] * n, "held": [True] * n, "with_text": [True] * n, "text": pa.array([zlib.compress(t.encode(), 1) for t in texts], pa.binary())})
    keys = np.array([0, *((1 << Q.ORDER_SHIFT) + i for i in range(97, 123))])
    answers = pa.table({"lang": ["x"] * len(keys), "key": keys, **{c: np.full(len(keys), -4, np.float32) for c in ("p0", "b0", "p1", "b1")}})
    return docs, answers


def test_texts_go_back_in_small_batches():
    docs, answers = _block(500)
    out = Q._score_block(docs, answers)
    batches = out.to_batches()
    assert sum(b.num_rows for b in batches) == 500 and max(b.nbytes for b in batches) < 2 * Q.OUT_BYTES
    assert out.column("text").to_pylist() == [zlib.decompress(t).decode() for t in docs.column("text").to_pylist()]


def test_a_block_is_scored_within_little_memory(monkeypatch):
    """Beside its input and result (Arrow buffers, not counted here); what is free goes back to the system before the result is made."""
    docs, answers = _block(600)
    calls = []
    monkeypatch.setattr(Q, "give_back", lambda: calls.append(1))
    Q._score_block(docs.slice(0, 1), answers)  # tables of characters
    tracemalloc.start()
    Q._score_block(docs, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak
    assert len(calls) == 2
    common.give_back()


def test_counts_go_out_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(Q, "OUT_ROWS", 7)
    monkeypatch.setattr(Q, "MAX_SUMS", 50)
    rows = [("abcdefgh " * 3, "x", False), ("hgfedcba", "x", True), ("abcd", "y", False), (None, "y", True)]
    got = {(r.lang, r.code): (r.n, r.n_held) for r in Q.count_fourgrams(spark.createDataFrame(rows, "text string, lang string, held boolean").coalesce(1)).collect()}
    want: dict = {}
    for text, lang, held in rows:
        for code in Q.Stretch([text or ""]).grams().tolist():
            n, h = want.get((lang, code), (0, 0))
            want[lang, code] = (n + 1, h + held)
    assert got == want
