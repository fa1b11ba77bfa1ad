"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums hashed n-gram counts per language in tasks, then by (language,
bucket) in one small shuffle, and writes them. The log-probability matrix is
broadcast for ``GROUP`` languages at a time, so that its size is fixed by the
parameters whatever the number of languages: documents are scored in numpy,
block by block, in one pass per group, and each pass carries on the best
language so far. Up to ``GROUP`` languages take one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokscope.llm.common import mix64, python_tasks, text_blocks, written

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages whose ``BUCKETS * GROUP`` cells are broadcast for one pass (8 MB of floats).
GROUP = 64
#: Languages a task counts in dense arrays before it hands them on.
DENSE = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased letter of every code point, 0 for what is not a letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def letter_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0 for others) of a block and the character offsets of its rows."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return _letters()[points], starts[offsets]


def ngram_buckets(codes: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: buckets and row numbers of the n-grams that stay in their row and hold a letter."""
    n = len(codes)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    wide = codes.astype(np.uint64) + np.uint64(1)
    for order in orders:
        m = n - order + 1
        if m <= 0:
            continue
        acc = np.full(m, order, np.uint64)
        letter = np.zeros(m, bool)
        for k in range(order):
            acc *= np.uint64(0x100000001B3)
            acc += wide[k : k + m]
            letter |= codes[k : k + m] != 0
        ok = letter & (row[:m] == row[order - 1 :])
        yield (mix64(acc[ok]) & np.uint64(buckets - 1)).astype(np.int32), row[:m][ok]


def held_out(doc_id: Column) -> Column:
    """True for documents kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class LanguageGroup:
    """Log priors and log likelihoods of one group of languages."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_prob: np.ndarray, orders: tuple[int, ...]):
        self.languages, self.log_prior, self.log_prob, self.orders = languages, log_prior, log_prob, orders

    def score_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row of a block: has a letter, index of the best language, its log score, sum of all scores relative to it."""
        rows, k = len(offsets) - 1, len(self.languages)
        codes, bounds = letter_codes(data, offsets)
        any_letter = np.diff(np.concatenate([[0], np.cumsum(codes != 0)])[bounds]) > 0
        logits = np.tile(self.log_prior, (rows, 1))
        for bucket, row in ngram_buckets(codes, bounds, self.orders, len(self.log_prob[0])):
            for j in range(k):
                logits[:, j] += np.bincount(row, weights=self.log_prob[j][bucket], minlength=rows)
        best = logits.argmax(axis=1)
        top = logits.max(axis=1)
        return any_letter, best, top, np.exp(logits - top[:, None]).sum(axis=1)


class LanguageModel:
    """Written counts ``(lang, bucket, n)`` (bucket -1: documents), handed out as groups of languages in alphabetical order."""

    def __init__(self, counts: DataFrame, buckets: int, orders: tuple[int, ...], smoothing: float, group: int):
        self.counts, self.buckets, self.orders, self.smoothing, self.group = counts, buckets, orders, smoothing, group
        rows, self.n_languages = counts.filter("bucket < 0").agg(F.sum("n"), F.count(F.lit(1))).first()
        self.rows = rows or 0

    def groups(self) -> Iterator[LanguageGroup]:
        after = None
        while True:
            names = self.counts.filter("bucket < 0").select("lang")
            if after is not None:
                names = names.filter(F.col("lang") > after)
            langs = [r.lang for r in names.orderBy("lang").limit(self.group).collect()]
            if not langs:
                return
            # At most (buckets + 1) rows of three numbers per language of the group.
            mine = self.counts.filter(F.col("lang").between(langs[0], langs[-1]))
            index = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("j")
            table = mine.select(index, "bucket", "n").toArrow()
            j, bucket, n = (table.column(x).to_numpy() for x in ("j", "bucket", "n"))
            docs, prob = np.zeros(len(langs)), np.full((len(langs), self.buckets), self.smoothing)
            head = bucket < 0
            docs[j[head]] = n[head]
            prob[j[~head], bucket[~head]] += n[~head]
            yield LanguageGroup(langs, np.log(docs / self.rows), np.log(prob / prob.sum(axis=1, keepdims=True)).astype(np.float32), self.orders)
            after = langs[-1]


def train(docs: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5, group: int = GROUP) -> LanguageModel | None:
    """Fit on the rows of ``text, lang`` with a language; None if there are none."""
    python_tasks(docs.sparkSession)
    names_out = ["lang", "bucket", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                ids = np.concatenate([[-1], at])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids, pa.int32()), pa.array(np.concatenate([[rows[lang]], total[at]]), pa.int64())], names_out)
            sums.clear()
            rows.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, last, data, offsets in text_blocks(batch):
                codes, bounds = letter_codes(data, offsets)
                names, index = np.unique(langs[first:last].astype(str), return_inverse=True)
                sizes = np.bincount(index)
                if len(names) > DENSE:
                    keys = [index[row].astype(np.int64) * buckets + bucket for bucket, row in ngram_buckets(codes, bounds, orders, buckets)]
                    key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
                    lang = np.concatenate([names, names[key // buckets]])
                    where = np.concatenate([np.full(len(names), -1), key % buckets])
                    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(where, pa.int32()), pa.array(np.concatenate([sizes, n]), pa.int64())], names_out)
                    continue
                for lang, n in zip(names, sizes, strict=True):
                    rows[lang] = rows.get(lang, 0) + int(n)
                    sums.setdefault(lang, np.zeros(buckets, np.int64))
                for bucket, row in ngram_buckets(codes, bounds, orders, buckets):
                    flat = np.bincount(index[row] * buckets + bucket, minlength=len(names) * buckets)
                    for j, lang in enumerate(names):
                        sums[lang] += flat[j * buckets : (j + 1) * buckets]
                if len(sums) > DENSE:
                    yield from held()
        yield from held()

    counts = docs.filter(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = LanguageModel(written(counts, "language-counts"), buckets, orders, smoothing, group)
    return model if model.n_languages else None


#: State of a document between passes: best language, its log score, sum of all scores relative to it.
_STATE = "lang_pred string, top double, total double"


def _score_group(docs: DataFrame, shared, more: bool) -> DataFrame:
    """One pass: ``doc_id, text`` and the state, brought up to date with a group of languages; texts only if ``more`` follow."""
    texts = ["text"] if more else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageGroup = shared.value
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            pred = np.array(batch.column(2).to_pylist(), dtype=object)
            top, total = (np.array(batch.column(i).to_numpy(zero_copy_only=False)) for i in (3, 4))
            for first, last, data, offsets in text_blocks(batch):
                known, best, high, part = m.score_block(data, offsets)
                old, so_far = top[first:last], total[first:last]
                # Groups come in alphabetical order, so an equal score does not replace an earlier one.
                better = known & (high > old)
                both = np.maximum(high, old)
                total[first:last] = np.where(known, so_far * np.exp(old - both) + part * np.exp(high - both), so_far)
                top[first:last] = np.where(known, both, old)
                pred[first:last] = np.where(better, names[best], pred[first:last])
            state = [pa.array(pred, pa.string()), pa.array(top), pa.array(total)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1 : 1 + len(texts)], *state], ["doc_id", *texts, "lang_pred", "top", "total"])

    return docs.mapInArrow(score, ", ".join(["doc_id long", *(f"{t} string" for t in texts), _STATE]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Predict ``lang_pred`` and ``score`` for every row of ``doc_id, text``.

    Edge cases: a null text, one without a letter, or no model at all give
    ``und`` with score 0. Equal scores go to the alphabetically first language.
    Repeated rows are scored each; other columns are not read. Above the
    model's group size the documents are written and read again after each
    group, so only one group's matrix is held at a time.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.selectExpr("*", "'und' as lang_pred", "double('-infinity') as top", "0d as total")
    for i, part in enumerate(model.groups() if model is not None else (), start=1):
        shared = spark.sparkContext.broadcast(part)
        rows = _score_group(rows, shared, more=i * model.group < model.n_languages)
        if model.n_languages > model.group:
            rows = written(rows, "language-pass", even=False)
            shared.destroy()
    score = F.when(F.col("total") > 0, 1 / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "lang_pred", score.alias("score"))


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents that are not held out, then predict all of them.

    ``lang`` is read for training rows only; predictions see the text alone.
    Any number of languages is learned.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))), **options)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
