"""Exact repeated-substring removal with a Burrows-Wheeler transform per shard.

A byte is removed if it lies in a ``min_length``-byte string that also starts
earlier (smaller ``doc_id``, or earlier in the same document).

1. *Sharding.* Every window of ``min_length`` bytes is filed under its anchor,
   the smallest hash of a ``SEED``-byte string in it (leftmost on ties). Equal
   windows have equal anchors at equal distances, so windows can be compared
   anchor by anchor. Neighbouring windows with one anchor form a segment; one
   row per segment is shuffled (about one per 37 bytes of text), and rows whose
   anchor occurs once end here.
2. *Copies.* Of segments with equal bytes, all but the first occurrence are
   repeats as a whole (those within a batch are told before the shuffle).
3. *Interval expansion.* Where an anchor has several different segments, their
   bytes are gathered (once each). A task concatenates the segments of its
   anchors, builds the Burrows-Wheeler transform, and extends intervals
   backwards, breadth first: level ``l`` separates suffixes whose common
   prefix is exactly ``l`` bytes. It stops at ``min_length``, so what is not
   separated by then shares a window of that length.
4. Spans are joined to the documents by id; bytes are cut in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokscope.llm.common import _BYTE_CODE, mix64, powers, prefix_hash, python_tasks, text_blocks, written

MIN_LENGTH = 100
SEED = 28
#: Ids of documents whose bytes are gathered are broadcast up to this number (8 bytes each), joined by a shuffle beyond.
MAX_BROADCAST_IDS = 2_000_000
#: Bytes of segments put into one transform.
SHARD_BYTES = 1 << 20
_POS_BITS = 24
_PIECE = 1 << 22


def segments(data: np.ndarray, offsets: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Segments of a block: ``(row, start, size, anchor position, anchor, hash of the bytes)``.

    Positions count from the start of the block.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if n > _PIECE:
        # Windows of a longer block are handled piece by piece; pieces overlap by one window less a byte.
        parts, at = [], 0
        while at < n - length + 1:
            end = min(at + _PIECE, n)
            inner = np.unique(np.concatenate([[0], np.clip(offsets - at, 0, end - at)]))
            _, start, size, pos, anchor, digest = segments(data[at:end], inner, length, seed)
            row = np.searchsorted(offsets, start + at, side="right") - 1
            parts.append((row, start + at, size, pos + at, anchor, digest))
            at = end - length + 1
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    sums = prefix_hash(_BYTE_CODE[data])
    _, down = powers(n + 1)
    m = n - seed + 1
    keys = mix64((sums[seed:] - sums[:m]) * down[:m])
    keys &= ~np.uint64((1 << _POS_BITS) - 1)
    keys |= np.arange(m, dtype=np.uint64)
    width, have = length - seed + 1, 1
    while have * 2 <= width:
        keys = np.minimum(keys[: len(keys) - have], keys[have:])
        have *= 2
    if have < width:
        gap = width - have
        keys = np.minimum(keys[: len(keys) - gap], keys[gap:])
    # keys[s] now is the least (hash, position) of the window that starts at s.
    pos = (keys & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    windows = len(pos)
    inside = np.zeros(windows, bool)
    row_of = np.zeros(windows, np.int32)
    for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= length:
            inside[a : b - length + 1] = True
            row_of[a : b - length + 1] = r
    new = inside.copy()
    new[1:] &= (pos[1:] != pos[:-1]) | ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= (pos[1:] != pos[:-1]) | ~inside[1:]
    start, last = np.flatnonzero(new), np.flatnonzero(stop)
    size = last - start + length
    apos = pos[start]
    anchor = mix64((sums[apos + seed] - sums[apos]) * down[apos])
    digest = mix64((sums[start + size] - sums[start]) * down[start] + (apos - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row_of[start].astype(np.int64), start, size, apos, anchor, digest


SEGMENT = "anchor long, digest long, doc_id long, row_mark int, start int, size int, lead int, copy boolean"


def local_copies(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an equal segment stands earlier among the given ones."""
    order = np.lexsort((at, mark, doc, anchor, digest))
    d, a = digest[order], anchor[order]
    same = np.concatenate([[False], (d[1:] == d[:-1]) & (a[1:] == a[:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = order[head]
    out = np.zeros(len(order), bool)
    out[order] = same & ((doc[first] != doc[order]) | (mark[first] != mark[order]) | (at[first] != at[order]))
    return out


def _segment_rows(length: int):
    """Task: one row per segment; ``lead`` is the distance from its start to its anchor.

    A segment that repeats one of the same batch is a ``copy`` whatever the
    rest holds. It gets an anchor of its own, so that a segment
    which very many documents share is shuffled at most once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            marks = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.int32)
            parts = []
            for first, _, data, offsets in text_blocks(batch):
                row, start, size, apos, anchor, digest = segments(data, offsets, length)
                parts.append((anchor, digest, ids[first + row], marks[first + row], start - offsets[row], size, apos - start))
            if not parts:
                continue
            anchor, digest, doc, mark, start, size, lead = (np.concatenate(c) for c in zip(*parts, strict=True))
            copy = local_copies(anchor, digest, doc, mark, start + lead)
            anchor[copy] = mix64(digest[copy] + start[copy].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc[copy].astype(np.uint64))
            cols = [anchor.view(np.int64), digest.view(np.int64), doc, mark, start.astype(np.int32), size.astype(np.int32), lead.astype(np.int32), copy]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in SEGMENT.split(", ")])

    return run


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``length`` symbols (prefix doubling).

    ``text`` holds codes from 0 on. Longer common prefixes are left in any
    order: intervals of strings of up to ``length`` symbols are unions of
    such ties, so the expansion sees the same intervals either way.
    """
    n = len(text)
    bits = int(text.max()).bit_length() or 1
    step = max(1, min(62 // bits, length))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key[: n - k] |= text[k:].astype(np.int64) << (bits * (step - 1 - k))
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if step >= length or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        step *= 2


def expand_intervals(text: np.ndarray, sa: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Split the suffixes by their first ``length`` symbols with the Burrows-Wheeler transform.

    Breadth-first backward extension: an interval of ``sa`` holds the suffixes
    that begin with some string; each symbol before them (in the transform)
    gives the interval of the string longer by one. An interval is followed only if one
    of its borders is new, so common prefixes come out by increasing
    length, and the search ends at ``length``. Symbol 0 separates texts and is
    never extended over. An interval of one suffix is not followed: a suffix
    that is unique from ``u`` symbols on makes the one before it unique from ``u + 1`` on.

    Returns, in suffix order, the borders found and whether each suffix shares its first ``length``
    symbols with another one; of those that do, two are equal if no border lies between them.
    """
    n = len(text)
    bwt = text[sa - 1]
    # A suffix's place after one more symbol: the stable order of the transform's symbols.
    lf = np.empty(n, np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    unique = np.full(n + 1, length + 1, np.int64)
    lo = np.searchsorted(text[sa], np.unique(text))
    hi = np.append(lo[1:], n)
    real = text[sa[lo]] != 0
    border[lo] = True
    lo, hi = lo[real], hi[real]
    level = 1
    while True:
        one = hi - lo == 1
        unique[sa[lo[one]]] = np.minimum(unique[sa[lo[one]]], level)
        lo, hi = lo[~one], hi[~one]
        if level >= length or not len(lo):
            break
        sizes = hi - lo
        which = np.repeat(np.arange(len(lo), dtype=np.int32), sizes)
        at = np.repeat((lo - np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(np.int32), sizes) + np.arange(len(which), dtype=np.int32)
        inner = bwt[at] != 0
        which, at = which[inner], at[inner]
        place = lf[at]
        # Sorted by place, one interval's suffixes with one symbol before them are neighbours.
        order = np.argsort(place)
        place, which, symbol = place[order], which[order], bwt[at[order]]
        head = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])])) if len(place) else np.zeros(0, np.int64)
        lo, hi = place[head], place[np.append(head[1:], len(place)) - 1] + 1 if len(place) else np.zeros(0, np.int64)
        fresh = ~(border[lo] & border[hi])
        border[lo] = True
        border[hi] = True
        lo, hi = lo[fresh], hi[fresh]
        level += 1
    # unique from u on at p: unique from u + k on at p - k.
    reach = np.minimum.accumulate((unique + np.arange(n + 1))[::-1])[::-1] - np.arange(n + 1)
    return border[:n], reach[sa] > length


def repeated_windows(segs: list[bytes], places: list[tuple], length: int) -> list[np.ndarray]:
    """Per segment: starts (within it) of the windows that an earlier segment also holds.

    ``places`` orders the segments strictly.
    """
    sizes = np.fromiter((len(s) for s in segs), np.int64, len(segs))
    raw = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # Dense codes from 1 on, 0 between segments (whatever bytes they hold).
    code = np.zeros(256, np.int32)
    present = np.flatnonzero(np.bincount(raw, minlength=256))
    code[present] = np.arange(1, len(present) + 1)
    text = code[raw]
    text[starts + sizes] = 0
    sa = suffix_order(text, length)
    border, shared = expand_intervals(text, sa, length)
    owner = np.repeat(np.arange(len(segs)), sizes + 1)[sa]
    within = sa - starts[owner]
    pick = np.flatnonzero(shared & (within + length <= sizes[owner]))
    group = np.cumsum(border)[pick]
    owner, within = owner[pick], within[pick]
    order = np.empty(len(segs), np.int64)
    order[sorted(range(len(segs)), key=places.__getitem__)] = np.arange(len(segs))
    place = order[owner]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    first = np.minimum.reduceat(place, heads) if len(group) else place
    again = place > np.repeat(first, np.diff(np.append(heads, len(group))))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segs)
    who, where = owner[again], within[again]
    by = np.argsort(who, kind="stable")
    who, where = who[by], where[by]
    cuts = np.flatnonzero(np.diff(who)) + 1
    if len(who):
        for k, part in zip(who[np.concatenate([[0], cuts])], np.split(where, cuts), strict=True):
            out[k] = part
    return out


def _expand_rows(length: int):
    """Task over ``anchor, doc_id, row_mark, start, lead, piece`` sorted by anchor: spans of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, anchor = 0, None

        def spans() -> pa.RecordBatch:
            # Windows of different anchors never are equal, so one transform serves many anchors.
            found = repeated_windows([r[5] for r in held], [(r[1], r[2], r[3] + r[4]) for r in held], length)
            doc, mark, start, size = [], [], [], []
            for r, windows in zip(held, found, strict=True):
                if len(windows):
                    # Windows that overlap are one span.
                    w = np.sort(windows)
                    gaps = np.flatnonzero(np.diff(w) > length)
                    begins, ends = w[np.append(0, gaps + 1)], w[np.append(gaps, len(w) - 1)] + length
                    doc += [r[1]] * len(begins)
                    mark += [r[2]] * len(begins)
                    start += (begins + r[3]).tolist()
                    size += (ends - begins).tolist()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((doc, pa.int64()), (mark, pa.int32()), (start, pa.int32()), (size, pa.int32()))], ["doc_id", "row_mark", "start", "size"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if size >= SHARD_BYTES and row[0] != anchor:
                    yield spans()
                    held, size = [], 0
                anchor = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield spans()

    return run


def _cut_rows(with_kept: bool):
    """Task over ``doc_id, text, spans``: bytes left after removing the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text, starts, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = (text or "").encode()
                lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if starts:
                    a = np.array(starts, np.int64)
                    b = a + np.array(sizes, np.int64)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.concatenate([[True], a[1:] > b[:-1]])
                    lo, hi = a[head], b[np.append(np.flatnonzero(head)[1:] - 1, len(b) - 1)]
                keep = [data[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True)]
                kept = b"".join(keep)
                for col, v in zip(out, (doc, len(data), len(data) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_spans(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Spans to remove: ``doc_id, row_mark, start, size`` (they may overlap)."""
    spark = docs.sparkSession
    python_tasks(spark)
    rows = docs.select("doc_id", "text", "row_mark")
    found = rows.mapInArrow(_segment_rows(min_length), SEGMENT)
    # One shuffle by anchor serves all of these; equal segments stand side by side, the first occurrence first.
    by_anchor = Window.partitionBy("anchor")
    in_order = Window.partitionBy("anchor", "digest").orderBy("doc_id", "row_mark", F.col("start") + F.col("lead"))
    found = found.withColumn("r", F.rank().over(in_order)).withColumn("lo", F.min("digest").over(by_anchor)).withColumn("hi", F.max("digest").over(by_anchor))
    found = found.withColumn("again", F.col("copy") | (F.col("r") > 1)).filter("again or lo < hi")
    kept = found.select("anchor", "doc_id", "row_mark", "start", "size", "lead", "again")
    found = written(kept, "repeat-segments", even=False)
    copies = found.filter("again").select("doc_id", "row_mark", "start", "size")

    several = found.filter("not again").groupBy("doc_id", "row_mark").agg(F.collect_set(F.struct("anchor", "start", "lead", "size")).alias("parts"))
    wanted = written(several, "repeat-wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS
    ids = wanted.select("doc_id").distinct()
    texts = rows.join(F.broadcast(ids), "doc_id", "left_semi") if few else rows
    pieces = texts.dropDuplicates(["doc_id", "row_mark"]).join(wanted, ["doc_id", "row_mark"])
    pieces = pieces.select("doc_id", "row_mark", F.col("text").cast("binary").alias("bytes"), F.explode("parts").alias("p"))
    pieces = pieces.select("p.anchor", "doc_id", "row_mark", "p.start", "p.lead", F.expr("substring(bytes, p.start + 1, p.size)").alias("piece"))
    pieces = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    part = pieces.mapInArrow(_expand_rows(min_length), "doc_id long, row_mark int, start int, size int")
    return copies.unionByName(part)


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, with_kept: bool = True) -> DataFrame:
    """Remove bytes covered by a ``min_length``-byte string that also starts earlier.

    Takes ``doc_id, text``; other columns are ignored. Returns ``doc_id,
    n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (binary: a cut may
    fall inside a character), one row per input row.

    Edge cases: a null text is empty; texts shorter than ``min_length`` stay
    whole. Rows with one id and equal texts are one document, and each
    keeps what it keeps; with different texts they are ordered by a text hash.
    Null ids come first. Empty tables give an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_mark", F.hash("text"))
    known = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    spans = repeated_spans(known, min_length).groupBy("doc_id", "row_mark").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    joined = known.join(spans, ["doc_id", "row_mark"], "left").select(F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text", "starts", "sizes")
    out = joined.mapInArrow(_cut_rows(with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_kept else out.drop("kept")
