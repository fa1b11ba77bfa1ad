"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

Per language, character four-grams of trusted documents are counted; counts of
all orders, continuation counts, discounts and back-off masses are joined by
(language, context) in Spark, sharded by hash, into one table of n-grams with
their interpolated log probability and the back-off weight they have as a
context. That table grows with the trusted text and is never gathered.

Documents are scored block by block (a stretch of one input partition): each
block asks for the distinct n-grams its documents hold, the requests meet the
table in a sharded join, and the answers meet the block's texts in a
co-grouped task, which adds up every document's bits.

Thresholds are quantiles, per language, of trusted documents that a model
trained without them scored: of the mean perplexity, and of the second worst
word (ordinary prose whose only fault are a few foreign words, such as insults,
has an ordinary mean).
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokscope.llm.common import give_back, python_tasks, written

ORDER = 4
SYMBOL_BITS = 12
SYMBOLS = 1 << SYMBOL_BITS
#: A key is an n-gram's symbols with its order above them.
ORDER_SHIFT = SYMBOL_BITS * ORDER
#: One trusted document in so many is held out of the model that thresholds are taken from.
FOLDS = 2
#: Trusted ids up to this number are broadcast (8 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Text bytes of a scoring block, on average, and characters handled at once: some dozen arrays of 8 bytes a character live at a time.
BLOCK_BYTES, CHUNK_CHARS = 16 << 20, 1 << 17
#: Text bytes and rows of a batch that goes back to the JVM, which holds it outside the heap.
OUT_BYTES, OUT_ROWS = 1 << 20, 1 << 16
#: N-grams that a counting task holds before it hands its sums on.
MAX_SUMS = 1 << 19
#: Share of capitals, digits, punctuation and symbols above which a document goes whose language has no threshold.
MAX_MARKS = 0.35
#: Letters of the words looked at one by one, and the marks that may follow them.
MIN_LETTERS, MARKS = 4, ".,;:!?"
ADDED = ("model", "n_scored", "perplexity", "threshold", "worst_word", "word_threshold", "kept")


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: itself below 2048, above one of 2048 by a hash."""
    out = np.arange(sys.maxunicode + 1, dtype=np.int32).astype(np.int16)
    for first in range(2048, len(out), CHUNK_CHARS):
        points = np.arange(first, min(first + CHUNK_CHARS, len(out)), dtype=np.uint64)
        out[first : first + CHUNK_CHARS] = 2048 + ((points * np.uint64(0x9E3779B1)) >> np.uint64(13)) % np.uint64(2048)
    return out


@lru_cache(maxsize=2)
def _kinds(letters: bool) -> np.ndarray:
    """Whether each code point is a letter; or else a capital, digit, punctuation mark or symbol of any script."""
    if letters:
        return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    categories = ("Lu", "Lt", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So")
    return np.fromiter((unicodedata.category(chr(i)) in categories for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Stretch:
    """Some texts as code points, each after ``ORDER - 1`` spaces; runs of white space are one space."""

    def __init__(self, texts: list[str]):
        pad = " " * (ORDER - 1)
        plain = [" ".join(t.split()) for t in texts]
        whole = "".join(pad + t for t in plain) + pad
        self.points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(t) for t in plain], dtype=np.int64)
        ends = np.cumsum(self.sizes + ORDER - 1)
        self.begins = ends - self.sizes  # of the texts, in points
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])  # of the texts, among their characters

    def places(self) -> np.ndarray:
        """Places of the texts' characters among the points."""
        return np.arange(self.bounds[-1]) + np.repeat(self.begins - self.bounds[:-1], self.sizes)

    def grams(self) -> np.ndarray:
        """The four-gram that ends at each character."""
        at, symbol = self.places(), _symbols()[self.points].astype(np.int64)
        out = symbol[at].copy()
        for k in range(1, ORDER):
            out |= symbol[at - k] << (SYMBOL_BITS * k)
        return out

    def mark_shares(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(_kinds(False)[self.points[self.places()]])])[self.bounds]
        return np.diff(sums) / np.maximum(self.sizes, 1)

    def second_worst(self, bits: np.ndarray) -> np.ndarray:
        """Second highest mean bits among each text's words (0 with fewer than two).

        Words are runs of ``MIN_LETTERS`` letters or more between two spaces, with
        at most one of ``MARKS`` behind; the character after the letters counts with them.
        """
        letter = _kinds(True)[self.points]
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        after, beyond = (self.points[np.minimum(ends + k, len(self.points) - 1)] for k in (0, 1))
        follows = (after == 32) | (np.isin(after, [ord(c) for c in MARKS]) & (beyond == 32))
        fit = (ends - begins >= MIN_LETTERS) & (self.points[np.maximum(begins - 1, 0)] == 32) & follows
        begins, ends = begins[fit], ends[fit]
        text = np.searchsorted(self.begins, begins, side="right") - 1
        shift = self.begins[text] - self.bounds[text]
        sums = np.concatenate([[0], np.cumsum(bits)])
        first, last = begins - shift, np.minimum(ends + 1 - shift, self.bounds[text + 1])
        mean = (sums[last] - sums[first]) / np.maximum(last - first, 1)
        by = np.lexsort((-mean, text))
        nth = np.arange(len(by)) - np.searchsorted(text[by], text[by])
        out = np.zeros(len(self.sizes))
        out[text[by][nth == 1]] = mean[by][nth == 1]
        return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS`` characters (a longer text is one of its own)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


# -- training -----------------------------------------------------------------------


def count_fourgrams(docs: DataFrame) -> DataFrame:
    """Counts ``lang, code, n, n_held`` over all rows of ``text, lang, held``; ``n_held`` is the part of held-out rows."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, held), (code, n) in sums.items():
                for a in range(0, len(code), OUT_ROWS):
                    some = n[a : a + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(code[a : a + OUT_ROWS]), pa.array(some), pa.array(some * held)], ["lang", "code", "n", "n_held"])
            sums.clear()

        for batch in batches:
            texts, langs, helds = (batch.column(i).to_pylist() for i in range(3))
            rows: dict[tuple[str, bool], list[str]] = {}
            for text, lang, held in zip(texts, langs, helds, strict=True):
                rows.setdefault((lang, held), []).append(text or "")
            for key, some in rows.items():
                for a, b in _chunks(some):
                    code, n = np.unique(Stretch(some[a:b]).grams(), return_counts=True)
                    if key in sums:
                        both = np.concatenate([sums[key][0], code])
                        code, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([sums[key][1], n])).astype(np.int64)
                    sums[key] = code, n
            if sum(len(c) for c, _ in sums.values()) > MAX_SUMS:
                yield from out()
        yield from out()
        give_back()

    counts = docs.select("text", "lang", "held").mapInArrow(run, "lang string, code long, n long, n_held long")
    return counts.groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("n_held").alias("n_held"))


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (SYMBOL_BITS * order)) - 1))


def kneser_ney_tables(counts: DataFrame) -> list[DataFrame]:
    """Discounted probabilities and back-off masses, one table per order, by sharded joins.

    ``counts`` has ``lang, model, code, n`` of the highest order. Lower orders
    use continuation counts (different left neighbours). The tables, from order 1
    up, have ``lang, model, code, prob, backoff``: ``prob`` is ``(c - D(c)) /
    c(context)`` of the n-gram and ``backoff`` the mass its context leaves to
    the next lower order. Each order is written before the next one is derived from it.
    """
    parts, by = [], ["lang", "model"]
    grams = counts.select(*by, "code", F.col("n").cast("double").alias("c"))
    for order in range(ORDER, 0, -1):
        freq = grams.groupBy(*by).agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        # Modified Kneser-Ney discounts, kept off their bounds so that no probability is zero; 0.5 without singletons or pairs.
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, a: str, b: str, y: Column = y) -> Column:
            d = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(b), F.col(a))
            return F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(d, F.lit(0.5)))).alias(f"d{k}")

        discounts = freq.select(*by, discount(1, "n1", "n2"), discount(2, "n2", "n3"), discount(3, "n3", "n4"))
        d = F.when(F.col("c") < 1.5, F.col("d1")).when(F.col("c") < 2.5, F.col("d2")).otherwise(F.col("d3"))
        g = grams.join(discounts, by).withColumn("d", d).withColumn("context", F.shiftright("code", SYMBOL_BITS))
        mass = g.groupBy(*by, "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        g = g.join(mass, [*by, "context"])
        parts.append(written(g.select(*by, "code", ((F.col("c") - F.col("d")) / F.col("total")).alias("prob"), (F.col("left") / F.col("total")).alias("backoff")), f"lm-order{order}"))
        if order > 1:
            grams = written(grams.select(*by, _suffix(F.col("code"), order - 1).alias("code")).groupBy(*by, "code").agg(F.count(F.lit(1)).cast("double").alias("c")), f"lm-counts{order - 1}")
    return parts[::-1]


def interpolated(tables: list[DataFrame]) -> DataFrame:
    """The model table ``lang, key, p0, b0, p1, b1`` from :func:`kneser_ney_tables`.

    ``p`` is the interpolated log2 probability of the n-gram ``key``, ``b`` the log2
    back-off weight it has as a context (null where it is none or not seen), of models 0 and 1.
    """
    by, rows, lower = ["lang", "model"], [], None
    for order, table in enumerate(tables, 1):
        if lower is None:
            p = F.lit(1.0 / SYMBOLS)
            full = table
        else:
            p = F.col("lower")
            full = table.withColumn("shorter", _suffix(F.col("code"), order - 1)).join(lower.select(*by, F.col("code").alias("shorter"), F.col("p").alias("lower")), [*by, "shorter"])
        full = full.select(*by, "code", (F.col("prob") + F.col("backoff") * p).alias("p"), "backoff")
        if order < ORDER:
            full = lower = written(full, f"lm-full{order}")
        key = F.col("code") + F.lit(order << ORDER_SHIFT)
        context = F.shiftright("code", SYMBOL_BITS) + F.lit((order - 1) << ORDER_SHIFT)
        nothing = F.lit(None).cast("double")
        rows.append(full.select(*by, key.alias("key"), F.log2("p").alias("p"), nothing.alias("b")))
        rows.append(full.select(*by, context.alias("key"), nothing.alias("p"), F.log2("backoff").alias("b")))
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    values = [F.max(F.when(F.col("model") == m, F.col(c))).cast("float").alias(f"{c}{m}") for m in (0, 1) for c in ("p", "b")]
    return all_rows.groupBy("lang", "key").agg(*values)


def train(trusted: DataFrame) -> DataFrame:
    """:func:`interpolated` of all rows of ``text, lang, held``: model 0 of all of them, model 1 without the held-out ones."""
    counts = written(count_fourgrams(trusted), "lm-counts")
    both = counts.select("lang", "code", F.explode(F.array(F.struct(F.lit(0).alias("model"), "n"), F.struct(F.lit(1).alias("model"), (F.col("n") - F.col("n_held")).alias("n")))).alias("x"))
    return written(interpolated(kneser_ney_tables(both.select("lang", "x.model", "code", "x.n").filter("n > 0"))), "lm-model")


# -- scoring ------------------------------------------------------------------------


def _keys(grams: np.ndarray) -> np.ndarray:
    """Keys of all n-grams and contexts that scoring distinct four-grams may look up."""
    out, codes = [], np.unique(grams)
    for order in range(ORDER, 0, -1):
        out.append(codes + (order << ORDER_SHIFT))
        codes = np.unique(np.concatenate([codes & ((1 << (SYMBOL_BITS * (order - 1))) - 1), codes >> SYMBOL_BITS]))
    return np.concatenate([[0], *out[::-1]])


def requests(docs: DataFrame) -> DataFrame:
    """Distinct ``block, lang, key`` of the rows ``block, lang, text``, whose blocks each lie in one task, in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        current = None

        def out() -> Iterator[pa.RecordBatch]:
            for lang, grams in seen.items():
                keys = _keys(grams)
                for a in range(0, len(keys), OUT_ROWS):
                    some = keys[a : a + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), current)), pa.array([lang] * len(some), pa.string()), pa.array(some)], ["block", "lang", "key"])
            seen.clear()

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if current is not None and blocks[a] != current:
                    yield from out()
                current = int(blocks[a])
                rows: dict[str, list[str]] = {}
                for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                    rows.setdefault(lang, []).append(text or "")
                for lang, some in rows.items():
                    for c, d in _chunks(some):
                        grams = np.unique(Stretch(some[c:d]).grams())
                        seen[lang] = np.union1d(seen[lang], grams) if lang in seen else grams
        yield from out()
        give_back()

    return docs.select("block", "lang", "text").mapInArrow(run, "block long, lang string, key long")


class BlockModel:
    """The answers to one block's requests for one language."""

    def __init__(self, keys: np.ndarray, values: list[np.ndarray]):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], [v[by] for v in values]

    def _find(self, keys: np.ndarray, column: int) -> np.ndarray:
        """Values of a column, NaN where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[column][at].astype(np.float64), np.nan)

    def covers(self, model: int) -> bool:
        return len(self.keys) > 0 and not np.isnan(self._find(np.zeros(1, np.int64), 2 * model + 1)[0])

    def bits(self, grams: np.ndarray, model: int) -> np.ndarray:
        """Minus log2 probability of the last symbol of each four-gram."""
        codes, inverse = np.unique(grams, return_inverse=True)
        total, todo = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            mine = codes[todo] & ((1 << (SYMBOL_BITS * order)) - 1)
            p = self._find(mine + (order << ORDER_SHIFT), 2 * model)
            seen = ~np.isnan(p)
            total[todo[seen]] -= p[seen]
            todo, mine = todo[~seen], mine[~seen]
            total[todo] -= np.nan_to_num(self._find((mine >> SYMBOL_BITS) + ((order - 1) << ORDER_SHIFT), 2 * model + 1))
        total[todo] += SYMBOL_BITS
        return total[inverse]


SCORES = T.StructType([T.StructField("n_scored", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("bits", "worst", "held_bits", "held_worst", "marks")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts (last column) for the shuffle: prose takes less than half."""
    for batch in batches:
        packed = [None if t is None else zlib.compress(t.encode(), 1) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], batch.schema.names)
    give_back()


def _unpacked(packed: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows and their texts (null: empty), about ``CHUNK_CHARS`` characters at a time (a longer text is one of its own)."""
    texts, first, size = [], 0, 0
    for i, row in enumerate(rows.tolist()):
        t = zlib.decompress(packed[row].as_buffer()).decode() if packed[row].is_valid else ""
        if texts and size + len(t) > CHUNK_CHARS:
            yield rows[first:i], texts
            texts, first, size = [], i, 0
        texts.append(t)
        size += len(t)
    if texts:
        yield rows[first:], texts


def _whole_texts(packed: pa.Array) -> pa.ChunkedArray:
    """The texts in pieces of about ``OUT_BYTES``, each of which goes back in a batch of its own."""
    pieces, texts, size = [], [], 0
    for t in packed:
        texts.append(zlib.decompress(t.as_buffer()) if t.is_valid else None)
        size += len(texts[-1] or b"")
        if size >= OUT_BYTES:
            pieces.append(pa.array(texts, pa.binary()).cast(pa.string()))
            texts, size = [], 0
    pieces.append(pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.chunked_array(pieces, pa.string())


def _score_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
    langs, held = (docs.column(c).to_pylist() for c in ("lang", "held"))
    packed = docs.column("text").combine_chunks()
    # A language is one number here, not one string a row.
    asked = answers.column("lang").combine_chunks().dictionary_encode()
    number_of = {lang: i for i, lang in enumerate(asked.dictionary.to_pylist())}
    asked = asked.indices.to_numpy(zero_copy_only=False)
    keys, values = answers.column("key").to_numpy(), [answers.column(c).to_numpy() for c in ("p0", "b0", "p1", "b1")]
    out = {f.name: np.full(len(packed), np.nan) for f in SCORES.fields}
    out["n_scored"] = np.zeros(len(packed), np.int64)
    order = np.argsort(np.array(langs, dtype=object), kind="stable")
    for lang in dict.fromkeys(langs):
        mine = asked == number_of.get(lang, -1)
        model = BlockModel(keys[mine], [v[mine] for v in values])
        rows = order[[langs[i] == lang for i in order]]
        for some, texts in _unpacked(packed, rows):
            stretch = Stretch(texts)
            grams = stretch.grams()
            out["n_scored"][some], out["marks"][some] = stretch.sizes, stretch.mark_shares()
            for number, (mean, worst) in enumerate((("bits", "worst"), ("held_bits", "held_worst"))):
                if not model.covers(number) or (number and not any(held[i] for i in some)):
                    continue
                bits = model.bits(grams, number)
                sums = np.concatenate([[0], np.cumsum(bits)])[stretch.bounds]
                with np.errstate(invalid="ignore"):
                    out[mean][some] = np.diff(sums) / np.where(stretch.sizes > 0, stretch.sizes, np.nan)
                out[worst][some] = stretch.second_worst(bits)
            del texts, stretch, grams
    give_back()  # here and not after the block, whose result still has to be sent
    result = docs.select(["row", "lang", "held"])
    if docs.column("with_text")[0].as_py():
        result = result.append_column("text", _whole_texts(packed))
    else:
        result = result.append_column("text", pa.nulls(len(packed), pa.string()))
    for name, values in out.items():
        result = result.append_column(name, pa.array(values, from_pandas=True))
    return result


def scored(docs: DataFrame, model: DataFrame, with_text: bool) -> DataFrame:
    """Score every row of ``row, text, lang, held``: ``row, lang, held, text`` (null unless asked for) and ``SCORES``.

    A block is a stretch of rows of one partition, so both readings of ``docs``
    must deal its rows alike, see :func:`_stable`. Texts move once, compressed.
    """
    python_tasks(docs.sparkSession)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    rows = max(1, BLOCK_BYTES * size["n"] // max(size["b"] or 1, 1))
    per_part = -(-(1 << 33) // rows)
    numbered = docs.withColumn("place", F.monotonically_increasing_id())
    block = F.shiftright("place", 33) * per_part + F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / rows).cast("long")
    numbered = numbered.withColumn("block", block)
    answers = requests(numbered).join(model, ["lang", "key"])
    left = numbered.select("block", "row", "lang", "held", F.lit(with_text).alias("with_text"), "text")
    left = left.mapInArrow(_packed, T.StructType([*left.schema.fields[:-1], T.StructField("text", T.BinaryType())]))
    schema = T.StructType([*(left.schema[c] for c in ("row", "lang", "held")), T.StructField("text", T.StringType()), *SCORES.fields])
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block, schema)


def _stable(docs: DataFrame) -> DataFrame:
    """``docs``, written first if its plan has a shuffle, which may deal rows differently when it runs again."""
    return written(docs, "lm-docs", texts=True) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic (a missing toxic label counts as not toxic)."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    return labels.filter((F.col("quality") == 1) & (toxic == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def cuts_of(held: DataFrame, quantile: float, typical: float, word_quantile: float, margin: float) -> DataFrame:
    """Thresholds ``lang, cut, usual, word_cut`` in bits from held-out trusted rows ``lang, held_bits, held_worst``.

    ``cut`` is ``margin`` times the ``quantile`` of the mean bits, ``usual`` their
    ``typical`` quantile, and ``word_cut`` ``margin`` times the ``word_quantile`` of the second worst word among documents
    up to ``usual`` (beyond it stand, say, texts in two languages, whose worst
    words tell nothing). Where it is larger, a normal bound for one more
    document after ``n`` is taken instead of a quantile (mean + z * (1 + (z^2 + 1) / 4 / (n - 1)) *
    sqrt(1 + 1 / n) * deviation): with few held-out documents, the largest
    of them says little. One document alone bounds nothing: its language has no cut.
    """

    def cut(column: str, q: float, name: str) -> Column:
        z = NormalDist().inv_cdf(q)
        n = F.count(column).cast("double")
        bound = F.avg(column) + z * (1 + (z * z + 1) / 4 / (n - 1)) * F.sqrt(1 + 1 / n) * F.stddev_samp(column)
        return F.when(n > 1, F.greatest(F.percentile_approx(column, F.lit(q), F.lit(10_000)), bound) * margin).alias(name)

    usual = F.percentile_approx("held_bits", F.lit(typical), F.lit(10_000)).alias("usual")
    means = held.groupBy("lang").agg(cut("held_bits", quantile, "cut"), usual)
    words = held.join(means, "lang").filter(F.col("held_bits") <= F.col("usual")).groupBy("lang").agg(cut("held_worst", word_quantile, "word_cut"))
    return means.join(words, "lang", "left")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, typical: float = 0.95, word_quantile: float = 0.985, margin: float = 1.05, min_chars: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Keep or reject every document by its perplexity under the trusted model.

    ``docs`` needs ``doc_id, text``, and ``lang`` if there is one; its columns (or those of ``keep``) pass through, except
    that columns named like a result are replaced. ``labels`` needs ``doc_id,
    quality`` (1 is trusted) and may have ``toxic``. Adds ``model`` (the
    language, null where no trusted text covers it), ``n_scored``,
    ``perplexity`` (per character), ``threshold``, ``worst_word`` (perplexity per
    character of the second worst word), ``word_threshold``, ``kept``. A
    document is rejected if its perplexity exceeds the threshold, or if it is
    no higher than usual and the worst word exceeds its own, see :func:`cuts_of`.

    Edge cases: a null or empty text (fewer than ``min_chars`` characters) is
    rejected, with a null perplexity. Rows without a language count as one.
    Where a language has no trusted documents, or no two held-out ones,
    perplexity tells nothing: ``threshold`` is null and only ``MAX_MARKS``
    rejects. Repeated rows are judged each.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    return _judged(docs, labels, (quantile, typical, word_quantile, margin), min_chars, keep).select("row.*", *ADDED)


def _judged(docs: DataFrame, labels: DataFrame, levels: tuple[float, float, float, float], min_chars: int, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``keep``) and the columns ``ADDED``."""
    docs = _stable(docs)
    has_lang = "lang" in [c.lower() for c in docs.columns]
    # The text travels by itself; a text column among the kept ones is put back afterwards.
    plain = [c for c in keep if c.lower() != "text" or docs.schema[c].dataType != T.StringType()]
    row = F.struct(F.col("doc_id").alias("id"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in plain]).alias("kept")).alias("row")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if has_lang else F.lit("")
    given = docs.select(row, F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held"))
    ids = written(trusted_ids(labels), "trusted-ids")
    few = ids.count() <= MAX_BROADCAST_IDS
    model = train(given.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text", "lang", "held"))
    scores = written(scored(given.drop("doc_id"), model, len(plain) < len(keep)), "lm-scores", texts=True)
    trusted = scores.filter("held and held_bits is not null").select(F.col("row.id").alias("doc_id"), "lang", "held_bits", "held_worst").join(ids, "doc_id", "left_semi")
    cuts = written(cuts_of(trusted, *levels), "lm-cuts")
    judged = scores.join(cuts, "lang", "left")
    known = F.col("cut").isNotNull() & F.col("bits").isNotNull()
    words = (F.col("bits") > F.col("usual")) | F.col("word_cut").isNull() | (F.col("worst") <= F.col("word_cut"))
    fits = F.when(known, (F.col("bits") <= F.col("cut")) & words).otherwise(F.col("marks") <= MAX_MARKS)
    kept = F.coalesce((F.col("n_scored") >= min_chars) & fits, F.lit(False))
    power = lambda c: F.pow(F.lit(2.0), F.col(c))
    threshold = [F.when(known, power(c)) for c in ("cut", "word_cut")]
    return judged.select(
        F.struct(*[F.col("text").alias(c) if c not in plain else F.col("row.kept")[c].alias(c) for c in keep]).alias("row"), F.when(F.col("bits").isNotNull(), F.col("lang")).alias("model"), "n_scored", power("bits").alias("perplexity"), threshold[0].alias("threshold"),
        F.when(F.col("bits").isNotNull(), power("worst")).alias("worst_word"), threshold[1].alias("word_threshold"), kept.alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, typical: float = 0.95, word_quantile: float = 0.985, margin: float = 1.05, min_chars: int = 1) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with the columns of ``docs``, whatever their names."""
    return _judged(docs, labels, (quantile, typical, word_quantile, margin), min_chars, docs.columns).filter("kept").select("row.*")
