"""Token ids as Parquet list columns that can be read selectively.

A token folder holds two tables. ``ids`` has one row per document in ascending
``doc_id`` order: the list of its token ids (dictionary or delta encoded) beside
small metadata columns. Row groups and pages are kept to given sizes and carry
column and offset indexes, so a filter on ``doc_id`` or on a range of token
positions skips files, row groups and pages, and a metadata read never touches
the ids. ``parts`` has one row per file with the position of its first token
in the whole sequence.

Documents are range-partitioned by id, sorted and encoded in that order, so each
task writes one file and knows the positions inside it; a file's place in the
whole sequence is the sum over the files before it, one row a file.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokscope.llm.common import python_tasks, text_blocks
from tokscope.llm.packing import tokenizer_path
from tokscope.session import bounded_broadcast

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
IDS = "part int, file_start long, doc_id long, n_tokens int, ids array<int>"
PARTS = "part int, first_token long, n_tokens long, n_docs long"

# Fixed by the vocabulary file: its normalizer and split, under which words parted by ASCII white space never affect each other.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: ASCII punctuation. A run of it that a word ends in is one piece of the split after letters.
MARKS = string.punctuation
#: White space that parts words.
SPACES = " \t\n\r"
#: Words that a worker remembers, words encoded in one call, and text bytes split into words at once (a longer text by itself).
MEMO_WORDS, CHUNK_WORDS, WORD_BYTES = 400_000, 256, 1 << 20


@dataclass(frozen=True)
class TokenLayout:
    """How the ``ids`` table is laid out.

    ``encoding``: ``dictionary`` (ids as bit-packed dictionary numbers, best for
    vocabularies) or ``delta`` (DELTA_BINARY_PACKED). ``row_group_bytes`` is the
    size of a row group in the writer's memory; a page ends after ``page_bytes``
    or ``page_rows`` documents, whichever comes first.
    """

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"encoding is dictionary or delta, not {self.encoding!r}")
        by_dictionary = self.encoding == "dictionary"
        return {
            "compression": self.compression,
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#part": "true",
            "parquet.enable.dictionary#ids.list.element": str(by_dictionary).lower(),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
        }


def splits_at_space(spec: dict) -> bool:
    """Whether a ``tokenizer.json`` is known to encode words parted by ASCII white space on their own."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == WORD_NORMALIZERS
        and steps[0] == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
        and not steps[1].get("add_prefix_space")
        and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        # Letters with marks behind, see _form, hold no added token.
        and not any(t["content"].rstrip(MARKS).isalpha() or not t["content"].rstrip(MARKS) for t in spec.get("added_tokens", []))
    )

_BYTES = np.arange(256, dtype=np.uint8)
_IS_SPACE, _IS_MARK = (np.isin(_BYTES, [ord(c) for c in chars]) for chars in (SPACES, MARKS))
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWERED = np.where(_IS_UPPER, _BYTES | 32, _BYTES).astype(np.uint8)
_IS_LETTER = (_LOWERED >= 97) & (_LOWERED <= 122)


def _form(word: str) -> tuple[str, str] | None:
    """A word as lower-case letters that the normalizer leaves as they are and the marks behind them; None if it is not.

    Letters are those below U+2000, without the two capitals whose lower case depends on more than the letter.
    """
    low = word.lower()
    stem = low.rstrip(MARKS)
    if not stem.isalpha():
        return None
    if stem.isascii() or (max(stem) < "\u2000" and "\u0130" not in word and "\u03a3" not in word and unicodedata.is_normalized("NFC", stem)):
        return stem, low[len(stem) :]
    return None


class TextEncoder:
    """Encodes texts with the ``tokenizers`` library, each distinct word once where the file allows that.

    Words seen lately are remembered in two generations of at most
    ``MEMO_WORDS``: a full one becomes the old one, from which words still in
    use are taken over.
    """

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_space(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = spec["model"]["vocab"]
        self.closes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
        if self.by_word and suffix:
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.has_closes = bool(self.closes.any())
        # The same model without normalizer and regular expressions, for words that these leave as they are.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.array(e.ids, dtype=np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _learn(self, letters: list[str], others: list[str]) -> None:
        """Add the ids of words to the memo; ``letters`` are stems of :func:`_form`."""
        memo = self.memo
        chunks = [letters[i : i + CHUNK_WORDS] for i in range(0, len(letters), CHUNK_WORDS)]
        # A run of letters is one piece of the split, so its last token, and no other, ends a word.
        for chunk, ids in zip(chunks, self._ids(self.bare, [" ".join(c) for c in chunks]), strict=True):
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            memo.update(zip(chunk, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        memo.update(zip(others, (ids.tobytes() for ids in self._ids(self.tokenizer, others)), strict=True))

    def _words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        found = list(map(memo.get, words))
        # The split parts letters from marks and the normalizer lower-cases, so "Word," is "word" and ",".
        forms, others, missing = {}, [], [i for i, ids in enumerate(found) if ids is None]
        for w in map(words.__getitem__, missing):
            if (ids := old.get(w)) is not None:
                memo[w] = ids
            elif (form := _form(w) if self.has_closes else None) is not None:
                forms[w] = form
            else:
                others.append(w)
        stems = {stem for stem, _ in forms.values()}.difference(memo)
        marks = {mark for _, mark in forms.values()}.difference(memo, others, [""])
        self._learn(list(stems), [*others, *marks])
        for w, (stem, mark) in forms.items():
            if mark or w != stem:
                memo[w] = memo[stem] + memo[mark] if mark else memo[stem]
        for i in missing:
            found[i] = memo[words[i]]
        return found

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after the other, as 32-bit integers, and where each text's ids end."""
        if not self.by_word:
            rows = list(self._ids(self.tokenizer, [t or "" for t in texts.to_pylist()]))
            return np.concatenate([*rows, np.zeros(0, np.int32)]), np.cumsum([len(r) for r in rows], dtype=np.int64)
        parts, ends, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for _, _, data, offsets in text_blocks(pa.RecordBatch.from_arrays([texts], ["text"]), limit=WORD_BYTES):
            words, stops = _block_words(data, offsets)
            coded = words.dictionary_encode()
            raws, at = self._words_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
            ids = np.frombuffer(b"".join(raws), dtype=np.int32)
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) >> 2
            begins, mine = (np.cumsum(sizes) - sizes)[at], sizes[at]
            upto = np.concatenate([[0], np.cumsum(mine)])
            parts.append(ids[np.repeat(begins - upto[:-1], mine) + np.arange(upto[-1])])
            ends.append(size + upto[stops])
            size += int(upto[-1])
        return np.concatenate(parts), np.concatenate(ends)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit integers."""
        ids, ends = self.encode_flat(pa.array(texts, pa.large_string()))
        return np.split(ids, ends)[:-1]


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of a block of texts (UTF-8 bytes, offsets of the rows) in order, and the number of words up to each row's end.

    Words are parted by ``SPACES`` and rows. Where a word is ASCII letters with nothing but ``MARKS``
    behind, the letters are lower-cased and the marks are a word of their own: it gives the same ids.
    """
    inside = ~_IS_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    stops = np.searchsorted(np.flatnonzero(start), offsets[1:])
    flat, start = data[inside], start[inside]
    begins = np.flatnonzero(start)
    letter, mark = _IS_LETTER[flat], _IS_MARK[flat]
    after = np.zeros(len(flat), bool)  # whether the byte before is a letter of the same word
    after[1:] = letter[:-1] & ~start[1:]
    odd = ~(letter | mark) | (letter & ~(after | start)) | (start & ~letter)
    plain = ~np.logical_or.reduceat(odd, begins) if len(begins) else np.zeros(0, bool)
    whole = np.repeat(plain, np.diff(begins, append=len(flat)))
    flat = np.where(whole, _LOWERED[flat], flat)
    cut = mark & after & whole
    pieces = np.flatnonzero(start | cut)
    words = pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(np.append(pieces, len(flat))), pa.py_buffer(flat)])
    # Words up to a row's end, and the cuts in them.
    return words, np.searchsorted(pieces, np.append(begins, len(flat))[stops])


@lru_cache(maxsize=2)
def text_encoder(name: str = TOKENIZER) -> TextEncoder:
    return TextEncoder(name)


def _encode_in_order(tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        position = 0
        tail = np.array([] if end_id is None else [end_id], dtype=np.int32)
        for batch in batches:
            plain, ends = encoder.encode_flat(batch.column(1))
            whole = np.insert(plain, np.repeat(ends, len(tail)), np.tile(tail, len(ends)))
            ends = ends + len(tail) * np.arange(1, len(ends) + 1)
            sizes = np.diff(ends, prepend=0)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(whole))
            starts = position + ends - sizes
            position += int(sizes.sum())
            columns = [pa.array(np.full(len(ends), part, np.int32)), pa.array(starts), batch.column(0), pa.array(sizes.astype(np.int32)), ids]
            yield pa.RecordBatch.from_arrays(columns, ["part", "file_start", "doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int | None = END_ID, layout: TokenLayout | None = None) -> None:
    """Encode ``doc_id, text`` and write a token folder at ``path`` (shared by all machines).

    Other columns are ignored, whatever their names. ``end_id`` closes each
    document; None leaves it out.

    Edge cases: a null or empty text is the end id alone. A null ``doc_id``
    comes first. Rows with one ``doc_id`` stay rows of their own, ordered by
    text; equal rows are interchangeable. An empty table gives empty tables. A
    text is encoded whole, whatever its length.
    """
    python_tasks(docs.sparkSession)
    layout = layout or TokenLayout()
    # The last key tells equal rows apart, so that many of them need not share a task.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("nth", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", F.xxhash64("text"), "nth").sortWithinPartitions("doc_id", F.xxhash64("text"), "nth")
    ids = ordered.select("doc_id", "text").mapInArrow(_encode_in_order(tokenizer, end_id), IDS)
    ids.write.options(**layout.options()).parquet(f"{path}/ids")
    files = _ids(docs.sparkSession, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts = files.select(F.col("part"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"), "n_tokens", "n_docs")
    parts.write.parquet(f"{path}/parts")


def _ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IDS).parquet(f"{path}/ids")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/parts")


def _placed(ids: DataFrame, parts: DataFrame) -> DataFrame:
    placed = ids.join(bounded_broadcast(parts.select("part", "first_token")), "part")
    return placed.withColumn("start", F.col("first_token") + F.col("file_start")).drop("part", "first_token", "file_start")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, start`` of every document; the ids are not read."""
    return _placed(_ids(spark, path).select("part", "file_start", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens")), _parts(spark, path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, start``; a filter on ``doc_id`` is pushed to row groups and pages."""
    return _placed(_ids(spark, path).withColumn("n_tokens", F.col("n_tokens").cast("long")), _parts(spark, path))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Tokens at positions ``first <= p < last`` of the whole sequence: ``doc_id, start, ids`` cut to the range.

    Only the files that hold the range are opened beyond their footers, and in
    them only row groups and pages whose positions can overlap it.
    """
    hit = _parts(spark, path).filter((F.col("first_token") < last) & (F.col("first_token") + F.col("n_tokens") > first))
    border = hit.agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("first_token").alias("a0"), F.max("first_token").alias("b0")).first()
    if border["a"] is None:
        return read_tokens(spark, path).select("doc_id", "start", "ids").limit(0)
    a, b = border["a"], border["b"]
    ids = _ids(spark, path).filter((F.col("part") >= a) & (F.col("part") <= b))
    ids = ids.filter((F.col("part") < b) | (F.col("file_start") < last - border["b0"]))
    ids = ids.filter((F.col("part") > a) | (F.col("file_start") + F.col("n_tokens") > first - border["a0"]))
    placed = _placed(ids, hit)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    take = F.least(F.col("start") + F.col("n_tokens"), F.lit(last)) - F.col("start") - skip
    cut = F.slice("ids", (skip + 1).cast("int"), take.cast("int"))
    return placed.filter(take > 0).select("doc_id", (F.col("start") + skip).alias("start"), cut.alias("ids"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows from :func:`read_tokens`, counted from the ids themselves.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    python_tasks(tokens.sparkSession)
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
