"""Chunking and batching.

The engine's unit of work is the document row; these operators exist for
users who need the analysed program's chunk/batch shapes. Every batch is
bounded (N documents, or a character threshold plus one document), so a
group never grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokscope.operators.ordinal import with_ordinal
from tokscope.session import bounded_broadcast, cut_lineage, ship_package

SINGLE_CHUNK_CHARS = 64 * 1024


def chunk_fixed(df: DataFrame, n_chars: int = SINGLE_CHUNK_CHARS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """P10: cut each text into ``n_chars``-character pieces ``(…, chunk_no, chunk)``, in one pass over it."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{n_chars}}}"), 0)
    return df.filter(F.length(text_col) > 0).select(*keep, F.posexplode(pieces).alias("chunk_no", "chunk"))


def _sorted_texts(order_col: str, text_col: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col])


def batch_by_count(
    df: DataFrame,
    batch_size: int,
    sep: str | None = " ",
    order_col: str = "doc_id",
    text_col: str = "text",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """B1 (sep ``" "``), B4 (sep ``"\\n"``), B3 (``sep=None``: keep a list).

    Every ``batch_size`` non-empty rows in ``order_col`` order form one
    batch; the remainder is kept. Rows are numbered with a distributed
    global ordinal (no single-task window); each batch holds at most
    ``batch_size`` texts. Texts are shuffled once, into the ordinal's buckets:
    a batch that lies within one bucket is put together there, and only the
    batches cut by a bucket border (at most two per bucket) move again.
    """
    rows = df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(order_col, *ties, text_col)
    numbered = with_ordinal(rows, order_col, ties, name="_ord", keep_bucket=True).withColumn(
        "batch_no", F.floor(F.col("_ord") / batch_size).cast("long")
    )
    item = F.struct(F.col("_ord"), F.col(text_col).alias("_t"))
    parts = numbered.groupBy("_b", "batch_no").agg(F.collect_list(item).alias("_items"), F.first("_off").alias("_off"), F.first("_n").alias("_n"))
    inside = (F.col("batch_no") * batch_size >= F.col("_off")) & ((F.col("batch_no") + 1) * batch_size <= F.col("_off") + F.col("_n"))
    whole = parts.filter(inside).select("batch_no", "_items")
    cut = parts.filter(~inside).groupBy("batch_no").agg(F.flatten(F.collect_list("_items")).alias("_items"))
    texts = F.transform(F.array_sort("_items"), lambda x: x["_t"])
    body = F.array_join(texts, sep) if sep is not None else texts
    return whole.unionByName(cut).select("batch_no", F.size("_items").cast("long").alias("n_docs"), body.alias("text" if sep is not None else "texts"))


def batch_lines(
    df: DataFrame, n_lines: int, order_col: str = "line_no", text_col: str = "text", ties: tuple[str, ...] = ()
) -> DataFrame:
    """``n_lines`` non-empty rows per batch, kept as a list."""
    return batch_by_count(df, n_lines, None, order_col, text_col, ties)


def batch_docs_newline(df: DataFrame, batch_size: int = 4096, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents joined by newlines, ``batch_size`` per batch."""
    return batch_by_count(df, batch_size, "\n", order_col, text_col)


def _prefix(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.cumsum(lengths)  # q[k]: chars of docs 0..k
    return q, np.concatenate(([0], q))  # before[j]: chars of docs 0..j-1


def _transfer_frame(threshold: int):
    """Per segment: exit run length as a piecewise-constant function of the entry run.

    With entry run ``r`` the first pack closes at the first ``k`` with
    ``r + q[k] >= T``; from then on the segment runs fresh, so the exit run
    only depends on that ``k``. ``close[j]`` is where a fresh run starting
    at ``j`` closes; following these pointers to the last fresh start
    (pointer doubling) gives the exit run for every ``k`` at once.
    """

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord", kind="stable")
        seg = int(pdf["_seg"].iloc[0])
        q, before = _prefix(pdf["_len"].to_numpy(np.int64))
        m = len(q)
        close = np.searchsorted(q, before[:m] + threshold, side="left")
        jump = np.concatenate((np.where(close >= m, np.arange(m), close + 1), [m]))
        for _ in range(int(np.ceil(np.log2(m + 1))) + 1):
            jump = jump[jump]
        exit_fresh = q[-1] - before[jump]  # exit run when running fresh from j
        last_k = min(int(np.searchsorted(q, threshold, side="left")), m - 1)
        ks = np.arange(last_k + 1)
        lo = np.maximum(0, threshold - q[ks])
        hi = threshold - before[ks]
        val = exit_fresh[ks + 1]
        # Merge neighbouring entry ranges with the same exit (runs converge fast).
        keep = np.concatenate(([True], val[1:] != val[:-1]))
        starts = np.flatnonzero(keep)
        ends = np.concatenate((starts[1:], [len(val)])) - 1
        return pd.DataFrame({"seg": seg, "lo": lo[ends], "hi": hi[starts], "val": val[starts]})

    return transfer


def _entry_runs(transfer: DataFrame, n_segments: int) -> DataFrame:
    """``(seg, entry)``: the run length carried into each segment.

    ``entry[0] = 0`` and ``entry[s+1] = f_s(entry[s])``. The chain is
    resolved by parallel-prefix composition of the per-segment functions:
    round ``k`` composes each function with the one ``2**k`` segments
    earlier (an equi-join on the segment id plus a range filter), so
    ``ceil(log2(#segments))`` rounds over a table of a few rows per
    segment, each round cut with a checkpoint.
    """
    g = transfer.withColumn("base", F.col("seg"))
    span = 1
    while span < n_segments:
        h = g.select(
            (F.col("seg") + span).alias("seg"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"),
            F.col("val").alias("h_val"), F.col("base").alias("h_base"),
        )
        open_rows = g.filter(F.col("base") > 0)
        done = g.filter(F.col("base") <= 0)
        composed = (
            open_rows.join(h, "seg")
            .filter((F.col("lo") <= F.col("h_val")) & (F.col("h_val") < F.col("hi")))
            .select("seg", F.col("h_lo").alias("lo"), F.col("h_hi").alias("hi"), "val", F.col("h_base").alias("base"))
        )
        g = cut_lineage(done.unionByName(composed))
        span *= 2
    at_zero = g.filter((F.col("lo") <= 0) & (F.col("hi") > 0)).select((F.col("seg") + 1).alias("seg"), F.col("val").alias("entry"))
    first = g.sparkSession.createDataFrame([(0, 0)], "seg long, entry long")
    return first.unionByName(at_zero.select(F.col("seg").cast("long"), F.col("entry").cast("long")))


def _ends_frame(threshold: int):
    """Per segment, from its true entry run: local pack index of every document."""

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord", kind="stable")
        entry = int(pdf["entry"].iloc[0])
        q, before = _prefix(pdf["_len"].to_numpy(np.int64))
        m = len(q)
        is_end = np.zeros(m, dtype=bool)
        k = int(np.searchsorted(q, threshold - entry, side="left"))
        while k < m:
            is_end[k] = True
            k = int(np.searchsorted(q, before[k + 1] + threshold, side="left"))
        ends_before = np.concatenate(([0], np.cumsum(is_end)[:-1]))
        return pd.DataFrame(
            {"_seg": pdf["_seg"].to_numpy(), "_ord": pdf["_ord"].to_numpy(), "_local": ends_before, "_n_ends": int(is_end.sum())}
        )

    return ends


def batch_by_chars(
    df: DataFrame,
    threshold: int = SINGLE_CHUNK_CHARS,
    packs_per_batch: int = 1,
    order_col: str = "doc_id",
    text_col: str = "text",
    segment_docs: int = 1_000_000,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """B2: greedy packing by character count, then ``packs_per_batch`` packs per batch.

    Rows are appended (in ``order_col`` order) until the summed length
    reaches ``threshold``; the pack is joined with ``" "`` and a new one
    starts; the last partial pack is kept. Exactly one sequential pass's
    packs, computed in parallel: the rows are cut into segments of at least
    ``threshold`` documents (so every segment closes a pack); each segment
    turns into a small function "run carried in -> run carried out"
    (``applyInPandas`` over ordinal and length only); the carried-in run of
    every segment is found by parallel-prefix composition; then each
    segment marks its pack ends, and a pack may span segments.

    Only keys and lengths are numbered and segmented. Equal keys go by
    ``ties``, then by a hash of the text; rows equal in all of these are
    interchangeable and told apart by a running number. The texts are joined back
    once, on these columns, and shuffled once more into packs (a pack holds at most
    ``threshold`` characters plus one document).
    """
    ship_package(df.sparkSession)
    seg_docs = max(segment_docs, threshold)
    rows = df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(order_col, *ties, text_col)
    key = [order_col, *ties, "_hash"]
    same = Window.partitionBy(*key).orderBy("_hash")
    texts = rows.withColumn("_hash", F.xxhash64(text_col)).withColumn("_dup", F.row_number().over(same))
    keys = rows.select(order_col, *ties, F.xxhash64(text_col).alias("_hash"), F.length(text_col).cast("long").alias("_len"))
    keys = keys.withColumn("_dup", F.row_number().over(same))
    numbered = with_ordinal(keys, order_col, [*ties, "_hash", "_dup"], name="_ord").withColumn("_seg", F.floor(F.col("_ord") / seg_docs).cast("long"))
    numbered = cut_lineage(numbered)
    lengths = numbered.select("_seg", "_ord", "_len")
    n_segments = lengths.agg(F.coalesce(F.max("_seg") + 1, F.lit(0))).first()[0]
    if n_segments == 0:
        return numbered.sparkSession.createDataFrame(
            [], "pack_no long, batch_no long, n_docs long, n_chars long, text string"
        )
    transfer = lengths.groupBy("_seg").applyInPandas(_transfer_frame(threshold), "seg long, lo long, hi long, val long")
    entries = _entry_runs(transfer, n_segments)
    with_entry = lengths.join(bounded_broadcast(entries.withColumnRenamed("seg", "_seg"), known_rows=n_segments), "_seg")
    local = with_entry.groupBy("_seg").applyInPandas(
        _ends_frame(threshold), "_seg long, _ord long, _local long, _n_ends long"
    )
    per_seg = local.groupBy("_seg").agg(F.first("_n_ends").alias("_n_ends"))
    upto = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # One row per segment of at least a million documents.
    seg_off = per_seg.select("_seg", F.coalesce(F.sum("_n_ends").over(upto), F.lit(0)).alias("_off"))
    packed = local.join(bounded_broadcast(seg_off, known_rows=n_segments), "_seg").select("_ord", (F.col("_off") + F.col("_local")).alias("_pack"))
    placed = numbered.select(*key, "_dup", "_ord").join(packed, "_ord")
    joined = texts.join(placed, [*key, "_dup"])
    packs = joined.groupBy("_pack").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.length(text_col)).cast("long").alias("n_chars"),
        F.array_join(_sorted_texts("_ord", text_col), " ").alias("text"),
    )
    return packs.select(
        F.col("_pack").alias("pack_no"),
        F.floor(F.col("_pack") / packs_per_batch).cast("long").alias("batch_no"),
        "n_docs",
        "n_chars",
        "text",
    )


def flatten(df: DataFrame, col: str, alias: str = "item") -> DataFrame:
    """One row per list element."""
    return df.select(F.explode(F.col(col)).alias(alias))
