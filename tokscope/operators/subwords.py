"""Subword models over pieces: merges of distinct pieces as a join, and the models on one piece.

A merge can only apply where its result stands, so byte-pair counting starts from
the places at which results occur in a piece. Its substrings are generated as rows; most of
those that are no entry are dropped in place by a bitmap over a checksum of all
entries, the rest by an equi-join. A piece of more than ``LONG`` symbols (text without spaces) is cut
into overlapping stretches first, so what one row builds stays bounded. The
other models, and ids in document order, are computed piece by piece in Arrow functions.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokscope.session import ship_package

#: Symbols up to which all substrings of a piece are built in one row.
LONG = 128
#: Bits of the bitmap per entry, and its largest size in 64-bit words (a constant of the plan).
BITS_PER_ENTRY, MAX_WORDS = 16, 1 << 15
#: Distinct pieces whose ids a task remembers while it encodes documents.
REMEMBERED = 200_000


def entry_bitmap(entries: Iterable[str]) -> str | None:
    """Bits set at the checksum of every entry, as comma-separated 64-bit words (a power of two); None if too many."""
    sums = np.array([zlib.crc32(e.encode()) for e in entries], dtype=np.int64)
    words = 1 << max(0, int(len(sums) * BITS_PER_ENTRY - 1).bit_length() - 6)
    if words > MAX_WORDS or not len(sums):
        return None
    bits = np.zeros(words, np.uint64)
    at = sums & (64 * words - 1)
    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return ",".join(map(str, bits.view(np.int64).tolist()))


def _maybe_entry(bitmap: str, sub: str) -> str:
    """SQL expression: whether the substring ``sub`` can be an entry."""
    words = bitmap.count(",") + 1
    table = f"cast(split('{bitmap}', ',') as array<bigint>)"
    return f"(shiftright({table}[cast(shiftright(crc32(cast({sub} as binary)) & {64 * words - 1}, 6) as int)], cast(crc32(cast({sub} as binary)) & 63 as int)) & 1) = 1"


def substrings(base: DataFrame, shortest: int, longest: int, suffix: str = "") -> DataFrame:
    """Rows of ``base`` (``spelled``, its length ``n_c``) with the places ``i, k, whole`` where an entry may stand.

    ``i`` counts symbols from 1 and ``k`` is a length from ``shortest`` to
    ``longest``; the last symbol carries ``suffix``. Every row of ``base`` also gives
    one row of ``i = 0`` without a place. Places are generated row by row, so that they are probed
    in the same codegen stage: no array of substrings is built.
    """
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    whole = "substring(spelled, i, k)"
    if suffix:
        whole = f"concat({whole}, if(i + k - 1 = n_c, {quoted(suffix)}, ''))"
    rows = base.withColumn("i", F.expr(f"explode(sequence(0, greatest(n_c - {shortest - 1}, 0)))"))
    rows = rows.withColumn("k", F.expr(f"explode(sequence(if(i = 0, 0, {shortest}), if(i = 0, 0, least({longest}, n_c - i + 1))))"))
    return rows.withColumn("whole", F.expr(f"if(i = 0, null, {whole})"))


def stretches(pieces: DataFrame, longest: int) -> DataFrame:
    """Pieces (``spelled``, its length ``n_c``) as rows of the same columns and ``is_head``, for :func:`substrings`.

    A piece of at most ``LONG`` symbols is one row. A longer one gives an empty
    row, its head, and overlapping stretches: every substring of up to ``longest``
    symbols lies in a stretch, and short of its end unless it ends the piece.
    """

    def cut(size: int, most: str) -> str:
        return f"transform(sequence(0, (least(length(spelled), {most}) - 1) div {size}), s -> struct(false as is_head, substring(spelled, cast(s * {size} + 1 as int), {size + longest}) as spelled))"

    # First large blocks, so that no stretch is looked for in the whole piece.
    blocks = f"if(n_c <= {LONG}, array(struct(true as is_head, if(n_c = 0, '', spelled) as spelled)), concat(array(struct(true as is_head, '' as spelled)), {cut(LONG * LONG, str(1 << 30))}))"
    rows = pieces.withColumn("_x", F.explode(F.expr(blocks))).withColumn("is_head", F.col("_x.is_head")).withColumn("spelled", F.col("_x.spelled"))
    parts = f"if(is_head, array(struct(true as is_head, spelled)), {cut(LONG, str(LONG * LONG))})"
    rows = rows.withColumn("_x", F.explode(F.expr(parts))).withColumn("spelled", F.col("_x.spelled"))
    return rows.withColumn("n_c", F.length("spelled")).drop("_x")


def longest_match(text: str, known: set[str], prefix: str, unk: str, longest: int, max_chars: int) -> list[str]:
    """Longest entry first, from where the last token ended; ``unk`` for a text it cannot finish or of more than ``max_chars``."""
    if len(text) > max_chars:
        return [unk]
    out, at = [], 0
    while at < len(text):
        lead = prefix if at else ""
        for end in range(min(len(text), at + longest), at, -1):
            if (token := lead + text[at:end]) in known:
                break
        else:
            return [unk]
        out.append(token)
        at = end
    return out


def best_path(n: int, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, unk_score: float) -> list[tuple[int, int, bool]]:
    """Best-scoring path over ``n`` symbols: ``(start, end, known)`` of its tokens.

    Entries are given by start, end and score. A symbol that is no entry by itself may be passed
    as unknown; among equal scores the earlier start wins.
    """
    order = np.lexsort((starts, ends))
    starts, ends, scores = starts[order].tolist(), ends[order].tolist(), scores[order].tolist()
    best, back = [0.0] * (n + 1), [(-1, True)] * (n + 1)
    at = 0
    for e in range(1, n + 1):
        top, come, single = None, (e - 1, False), False
        while at < len(ends) and ends[at] == e:
            s = starts[at]
            value = best[s] + scores[at]
            if top is None or value > top:
                top, come = value, (s, True)
            single = single or s == e - 1
            at += 1
        if not single:
            value = best[e - 1] + unk_score
            if top is None or value > top:
                top, come = value, (e - 1, False)
        best[e], back[e] = top, come
    out, e = [], n
    while e > 0:
        s, known = back[e]
        out.append((s, e, known))
        e = s
    return out[::-1]


def _path_ends(path: list[tuple[int, int, bool]]) -> list[int]:
    """Ends of the tokens of a path; neighbouring unknown symbols are one token."""
    return [e for j, (_, e, known) in enumerate(path) if known or j + 1 == len(path) or path[j + 1][2]]


@lru_cache(maxsize=2)
def _scores(text: str) -> dict[str, float]:
    return dict(reversed(json.loads(text)["model"]["vocab"]))


def best_tokens(text: str, scores: dict[str, float], longest: int, unk_score: float) -> list[str]:
    """Tokens of the best path by summed scores (:func:`best_path` over the entries that stand in ``text``).

    Neighbouring unknown symbols are one token, which the vocabulary does not hold.
    """
    n = len(text)
    best, back = [0.0] * (n + 1), [(0, True)] * (n + 1)
    for e in range(1, n + 1):
        top, come = None, (e - 1, False)
        for s in range(max(0, e - longest), e):
            score = scores.get(text[s:e])
            if score is not None and (top is None or best[s] + score > top):
                top, come = best[s] + score, (s, True)
        if text[e - 1] not in scores and (top is None or best[e - 1] + unk_score > top):
            top, come = best[e - 1] + unk_score, (e - 1, False)
        best[e], back[e] = top, come
    path, e = [], n
    while e > 0:
        s, known = back[e]
        path.append((s, e, known))
        e = s
    ends = _path_ends(path[::-1])
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def merge_lowest(symbols: list[str], rank: Callable[[str, str], int | None]) -> list[str]:
    """Join the neighbours of the lowest rank, leftmost first, until no pair has a rank."""
    n = len(symbols)
    text, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(text, text[1:])) if (r := rank(a, b)) is not None]
    heapify(queue)
    while queue:
        _, i, a, b = heappop(queue)
        j = after[i]
        if j >= n or text[i] != a or text[j] != b:
            continue  # one side has been joined since
        text[i], text[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(text[i], text[k])) is not None:
                heappush(queue, (r, i, text[i], text[k]))
        h = before[i]
        if h >= 0 and (r := rank(text[h], text[i])) is not None:
            heappush(queue, (r, h, text[h], text[i]))
    return [t for t in text if t]


@lru_cache(maxsize=2)
def _pair_ranks(text: str) -> dict[tuple[str, str], int]:
    merges = json.loads(text)["model"]["merges"]
    return {tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m): r for r, m in enumerate(merges)}


@lru_cache(maxsize=2)
def model_ids(text: str) -> dict[str, int]:
    """Ids of a file's own vocabulary; an id that an added token has is that token's only."""
    conf = json.loads(text)
    taken, vocab = {int(a["id"]) for a in conf.get("added_tokens", [])}, conf["model"]["vocab"]
    pairs = vocab.items() if isinstance(vocab, dict) else [(t, i) for i, (t, _) in reversed(list(enumerate(vocab)))]
    return {t: i for t, i in pairs if i not in taken}


@lru_cache(maxsize=2)
def _entries(text: str) -> frozenset[str]:
    """What a piece can hold: the vocabulary, and added tokens that are not special."""
    return frozenset(model_ids(text)) | {a["content"] for a in json.loads(text).get("added_tokens", []) if a.get("special") is False}


def model_function(spec) -> Callable[[str], list[str]]:
    """The tokenizer's model as a function of one spelled piece, for Arrow functions.

    Its tables come from the tokenizer's file (config-sized, read once per worker) or a rank file's ranks.
    """
    file, ranks, longest, suffix, whole = spec.text, spec.ranks, spec.max_token_chars, spec.suffix, spec.ignore_merges
    prefix, unk, most, unk_score = spec.prefix, spec.unk, spec.max_piece_chars, spec.unk_score
    if spec.model == "WordPiece":
        return lambda text: longest_match(text, _entries(file), prefix, unk, longest, most)
    if spec.model == "Unigram":
        return lambda text: best_tokens(text, _scores(file), longest, unk_score)

    def merged(text: str) -> list[str]:
        if whole and text in (ranks if ranks is not None else _entries(file)):
            return [text]
        symbols = list(text)
        if suffix and symbols:
            symbols[-1] += suffix
        if ranks is not None:
            return merge_lowest(symbols, lambda a, b: ranks.get(a + b))
        pairs = _pair_ranks(file)
        return merge_lowest(symbols, lambda a, b: pairs.get((a, b)))

    return merged


def model_tokens(pieces: DataFrame, spec) -> DataFrame:
    """Add ``tokens``: those of each row's ``spelled`` by the tokenizer's model, piece by piece in an Arrow function."""
    ship_package(pieces.sparkSession)
    model = model_function(spec)

    @F.arrow_udf("array<string>")
    def tokens(spelled: pa.Array) -> pa.Array:
        return pa.array([model(s) for s in spelled.to_pylist()], pa.list_(pa.string()))

    return pieces.withColumn("tokens", tokens("spelled"))


def token_ids(spec) -> Callable[[str, bool], int | None]:
    """Id of a token as a function, for Arrow functions: the unknown token's where the vocabulary lacks it, None where there is none."""
    file, ranks, added, unk = spec.text, spec.ranks, spec.added, spec.unk_id
    return lambda token, is_added: (added if is_added else ranks if ranks is not None else model_ids(file)).get(token, unk)


def tokens_to_ids(rows: DataFrame, spec) -> DataFrame:
    """Add ``ids`` to rows of ``tokens, is_added``; symbols without an id are dropped."""
    ship_package(rows.sparkSession)
    id_of = token_ids(spec)

    @F.arrow_udf("array<int>")
    def ids(tokens: pa.Array, added: pa.Array) -> pa.Array:
        # Each different token of a batch is looked up once.
        coded = tokens.flatten().dictionary_encode()
        sizes = tokens.value_lengths().fill_null(0).to_numpy()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + np.repeat(added.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        listed, found = coded.dictionary.to_pylist(), np.full(2 * len(coded.dictionary), -1, np.int64)
        for c in np.unique(codes).tolist():
            found[c] = -1 if (x := id_of(listed[c >> 1], bool(c & 1))) is None else x
        values = found[codes]
        ends = np.concatenate([[0], np.cumsum(values >= 0)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[values >= 0], pa.int32()))

    return rows.withColumn("ids", ids("tokens", "is_added"))


#: Characters of the byte-level alphabet by byte (see ``to_byte_level``).
BYTE_CHARS = [chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else chr(256 + (b if b <= 0x20 else b - 0x7F + 33 if b <= 0xA0 else 67)) for b in range(256)]


def pieces_to_ids(spec, texts: Column, added: Column) -> Column:
    """Ids of a row's pieces, in order: the model runs once for each distinct piece that a task remembers."""
    model, id_of, byte_level = model_function(spec), token_ids(spec), spec.byte_level

    def encoded(piece: str, is_added: bool) -> list[int]:
        spelled = "".join(BYTE_CHARS[b] for b in piece.encode()) if byte_level else piece
        tokens = [piece] if is_added else model(spelled)
        return [x for t in tokens if (x := id_of(t, is_added)) is not None]

    known: dict[tuple[str, bool], list[int]] = {}

    def remembered(pair: tuple[str, bool]) -> list[int]:
        found = known.get(pair)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[pair] = encoded(*pair)
        return found

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array, added: pa.Array) -> pa.Array:
        coded = texts.flatten().dictionary_encode()
        if not len(coded):
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        pieces, flags = coded.dictionary.to_pylist(), added.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        codes, place = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + flags, return_inverse=True)
        lists = pa.array([remembered((pieces[c >> 1], bool(c & 1))) for c in codes.tolist()], pa.list_(pa.int32()))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy()[place], dtype=np.int64)])
        rows = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), lists.take(pa.array(place)).flatten())

    return ids(texts, added)
