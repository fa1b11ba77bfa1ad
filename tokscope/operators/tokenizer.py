"""Tokenizer files as Spark plans: exact splits and byte-pair encoding without a library.

A tokenizer file (config-sized) is read once through Spark, by the same path
as every other input. From it come the *stages* that cut a text into pieces
(added tokens first, then the normalizer chain, then each pre-tokenizer split), as JVM regular
expressions and column expressions, and the parameters of the model (byte-pair,
WordPiece or Unigram), which is run as joins on the distinct
pieces (T4, ``subwords.py``). What cannot be reproduced exactly is said (``reason``), and callers
then encode whole texts with a library plug-in.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.functions.text import bytes_to_byte_level, to_byte_level
from tokscope.operators.normalize import Step, Unsupported, chain, java_literal, normalized
from tokscope.operators.subwords import LONG, entry_bitmap, model_tokens, pieces_to_ids, stretches, substrings, tokens_to_ids
from tokscope.session import bounded_broadcast, ship_package
from tokscope.sources.vocab import load_merges, load_vocab, read_tokenizer

# Fixed value: the public GPT-2 pre-token pattern, which byte-level
# pre-tokenizers apply when ``use_regex`` is on.
# Punctuation of the public BERT split: ASCII marks and category P.
BERT_PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SparkTokenizer:
    """A tokenizer file opened in a session: its spec, vocabulary and merge tables (config-sized, cached)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.spec = read_spec(spark, path)
        file = read_tokenizer(spark, path)
        self.vocab = load_vocab(file).cache()
        self.merges = load_merges(file).cache()

    def library_encoder(self, add_special_tokens: bool = False):
        """The ``tokenizers`` plug-in for the same file, for what Spark cannot run exactly."""
        from tokscope.operators.encode import HFTokenizerEncoder

        return HFTokenizerEncoder.from_text(self.spec.text, add_special_tokens, self.spark)


class RankFile:
    """A rank file (one ``base64 rank`` line per token) opened in a session, for ``token_frequency`` and the like.

    Such encoders join the neighbours whose union has the lowest rank, so every
    split of a token into two tokens is a merge with the token's rank; a
    piece that is a token is taken whole. ``pattern`` is the encoding's split.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str = BYTE_LEVEL_PATTERN):
        self.spark, self.path = spark, path
        fields = F.split("value", " ")
        raw = spark.read.text(path).filter("value <> ''").select(fields[1].cast("int").alias("token_id"), F.unbase64(fields[0]).alias("raw"))
        self.vocab = raw.select("token_id", bytes_to_byte_level(F.col("raw")).alias("token"), F.lit(False).alias("special")).cache()
        cuts = self.vocab.filter(F.length("token") > 1).select("token", F.col("token_id").alias("rank"), F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"))
        pairs = cuts.select("rank", F.substring("token", F.lit(1), F.col("k")).alias("left"), F.expr("substring(token, k + 1)").alias("right"))
        known = bounded_broadcast(self.vocab.select(F.col("token").alias("part")))
        pairs = pairs.join(known, F.col("left") == F.col("part"), "left_semi").join(known, F.col("right") == F.col("part"), "left_semi")
        self.merges = pairs.cache()
        longest = self.vocab.agg(F.max(F.length("token"))).first()[0] or 1
        # The bitmap is over the tokens; a vocabulary is config-sized.
        tokens = {r["token"]: r["token_id"] for r in self.vocab.select("token", "token_id").collect()}
        self.spec = TokenizerSpec("", (Stage("(?U)" + pattern),), {}, True, True, "", None, True, longest, ("\x01", "\x02", "\x03"), bitmap=entry_bitmap(tokens), ranks=tokens)

    def library_encoder(self):
        raise NotImplementedError("rank files are always encoded by Spark")


@dataclass(frozen=True)
class Stage:
    """One cut: of ``pattern`` matches and the text between them, ``keep`` says which become pieces (all, matches or gaps).

    ``final``: its matches are whole tokens (added tokens) that later stages
    leave alone. With ``steps`` the stage rewrites pieces instead of cutting them.
    """

    pattern: str = ""
    final: bool = False
    keep: str = "all"
    steps: tuple[Step, ...] = ()
    first_only: bool = False


@dataclass(frozen=True)
class TokenizerSpec:
    """What a tokenizer file says, as far as Spark can run it."""

    text: str = field(repr=False)
    stages: tuple[Stage, ...] | None
    added: dict[str, int] = field(repr=False)
    byte_level: bool
    native: bool
    reason: str
    unk_id: int | None
    ignore_merges: bool
    max_token_chars: int
    marks: tuple[str, str, str] = field(repr=False)
    model: str = "BPE"
    #: Marks of inner pieces (WordPiece) and of word ends (byte-pair).
    prefix: str = ""
    suffix: str = ""
    unk: str = ""
    max_piece_chars: int = 1 << 30
    #: Score of an unknown symbol (Unigram).
    unk_score: float = 0.0
    #: Bitmap of what can stand in a piece: results of merges, or vocabulary entries.
    bitmap: str | None = field(default=None, repr=False)
    #: Every merge comes after all merges that make its parts, as training produces them.
    ordered: bool = True
    #: Rank of every token of a rank file.
    ranks: dict[str, int] | None = field(default=None, repr=False)
    #: Ids that the post-processor's template for one text puts before and after it.
    before: tuple[int, ...] = ()
    after: tuple[int, ...] = ()
    #: Regular expression of stretches of a spelled piece that no token reaches out of (see :func:`_stretch_pattern`).
    stretch: str | None = field(default=None, repr=False)

    @property
    def digest(self) -> str:
        return hashlib.sha1(self.text.encode()).hexdigest()[:16]


def read_tokenizer_text(spark: SparkSession, path: str) -> str:
    """The tokenizer file's text, read through Spark (any path Spark can open)."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_spec(spark: SparkSession, path: str) -> TokenizerSpec:
    return parse_spec(read_tokenizer_text(spark, path))


def parse_spec(text: str) -> TokenizerSpec:
    conf = json.loads(text)
    model = conf["model"]
    kind = model.get("type", "BPE")
    added = {a["content"]: int(a["id"]) for a in conf.get("added_tokens", [])}
    vocab = model.get("vocab", {})
    entries = list(vocab) if isinstance(vocab, dict) else [t for t, _ in vocab]
    stages, byte_level, reason = _stages(conf)
    if not reason and kind not in ("BPE", "WordPiece", "Unigram"):
        reason = f"model {kind}"
    # Unigram always joins neighbouring unknown symbols, as the path here does.
    for key in ("dropout", "byte_fallback", *(("fuse_unk", "continuing_subword_prefix") if kind == "BPE" else ())):
        if not reason and model.get(key):
            reason = f"model option {key}"
    unk = model.get("unk_token")
    unk_id = model.get("unk_id") if kind == "Unigram" else None if unk is None else added.get(unk, vocab.get(unk) if isinstance(vocab, dict) else None)
    alphabet = set("".join(entries))
    # Characters no token holds: two mark symbol borders in the fold, one stands for them where a text has them.
    marks = tuple(c for c in map(chr, [*range(1, 32), *range(0xE000, 0xE100)]) if c not in alphabet)[:3]
    suffix = model.get("end_of_word_suffix") or ""
    prefix = (model.get("continuing_subword_prefix") or "") if kind == "WordPiece" else ""
    longest = max((len(t.removesuffix(suffix) if suffix else t.removeprefix(prefix)) for t in entries), default=1)
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    last = {a + b: rank for rank, (a, b) in enumerate(merges)}
    ordered = all(last.get(part, -1) < rank for rank, pair in enumerate(merges) for part in pair)
    before, after, template = _template(conf.get("post_processor"), added)
    apart = kind == "BPE" and ordered and not suffix and not model.get("ignore_merges")
    return TokenizerSpec(
        text, stages, added, byte_level, not reason, reason, unk_id, bool(model.get("ignore_merges")), longest, marks, kind,
        prefix=prefix, suffix=suffix, unk=unk or "", max_piece_chars=model.get("max_input_chars_per_word", 100) if kind == "WordPiece" else 1 << 30,
        unk_score=min((x for _, x in vocab), default=0.0) - 10 if kind == "Unigram" else 0.0,
        bitmap=entry_bitmap(last if kind == "BPE" else entries), ordered=ordered, before=before, after=after,
        stretch=_stretch_pattern(last) if apart else None,
    )


#: Alternatives of a stretch pattern; with more of them (nearly all neighbours occur in some token) pieces stay whole.
MAX_FOLLOWERS = 64


def _stretch_pattern(results: Iterable[str]) -> str | None:
    """Java regex that cuts a spelled piece between neighbours that stand side by side in no merge result.

    No token holds such a border, so no merge joins across it, and both sides are encoded as if they were alone.
    """
    follow: dict[str, set[str]] = {}
    for token in results:
        for a, b in zip(token, token[1:]):
            follow.setdefault(a, set()).add(b)
    groups: dict[frozenset[str], list[str]] = {}
    for a, after in sorted(follow.items()):
        groups.setdefault(frozenset(after), []).append(a)
    if not 0 < len(groups) <= MAX_FOLLOWERS:
        return None
    letters = lambda chars: "[" + "".join(java_literal(c) for c in sorted(chars)) + "]"
    return "(?s)(?:" + "|".join(f"{letters(firsts)}(?={letters(after)})" for after, firsts in groups.items()) + ")*+."


def _template(post: dict | None, added: dict[str, int]) -> tuple[tuple[int, ...], tuple[int, ...], bool]:
    """Special ids before and after one text, and whether the post-processor is one that only adds them."""
    kind = (post or {}).get("type")
    if kind == "Sequence":
        known = [_template(p, added) for p in post.get("processors", [])]
        return tuple(i for b, _, _ in reversed(known) for i in b), tuple(i for _, a, _ in known for i in a), all(ok for _, _, ok in known)
    if kind in ("BertProcessing", "RobertaProcessing"):
        return (int(post["cls"][1]),), (int(post["sep"][1]),), True
    if kind == "TemplateProcessing":
        sides: tuple[list[int], list[int]] = ([], [])
        seen = 0
        for part in post.get("single", []):
            if "Sequence" in part:
                seen = 1
            else:
                sides[seen].extend(int(i) for i in post["special_tokens"][part["SpecialToken"]["id"]]["ids"])
        return tuple(sides[0]), tuple(sides[1]), True
    return (), (), kind in (None, "ByteLevel")


def _stages(conf: dict) -> tuple[tuple[Stage, ...] | None, bool, str]:
    """``(stages, byte level, reason why not exact)``."""
    stages: list[Stage] = []
    for is_normalized in (False, True):
        if is_normalized:
            try:
                if steps := tuple(chain(conf.get("normalizer"))):
                    stages.append(Stage(steps=steps))
            except Unsupported as what:
                return None, False, str(what)
        group = [a for a in conf.get("added_tokens", []) if bool(a.get("normalized")) == is_normalized and a["content"]]
        if any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in group):
            return None, False, "an added token that looks at its surroundings"
        if group and is_normalized and conf.get("normalizer") is not None:
            return None, False, "an added token that is normalized"
        if group:
            # Leftmost, then longest.
            longest_first = sorted((a["content"] for a in group), key=lambda c: (-len(c), c))
            stages.append(Stage("|".join(java_literal(c) for c in longest_first), final=True))
    pre = conf.get("pre_tokenizer")
    parts = [] if not pre else pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else [pre]
    byte_level = False
    for p in parts:
        if byte_level:
            return None, False, "a split of byte-level text"
        more, reason = _pre_stages(p)
        if reason:
            return None, False, reason
        stages += more
        byte_level = p.get("type") == "ByteLevel"
    return tuple(stages), byte_level, ""


def _pre_stages(p: dict) -> tuple[list[Stage], str]:
    """Stages of one pre-tokenizer, or the reason why there are none."""
    kind = p.get("type")
    if kind == "Split":
        behavior = p.get("behavior")
        keep = "all" if behavior == "Isolated" and not p.get("invert") else {True: "matches", False: "gaps"}[bool(p.get("invert"))] if behavior == "Removed" else None
        if keep is None:
            return [], f"split behavior {behavior}"
        pat = p.get("pattern", {})
        pattern = pat["Regex"] if "Regex" in pat else java_literal(pat.get("String", ""))
        if not pattern or _may_be_empty(pattern):
            return [], "a split pattern that can match nothing"
        return [Stage("(?U)" + pattern, keep=keep)], ""
    if kind == "ByteLevel":
        spaced = Stage(steps=(lambda t: F.when((t == "") | t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t)),))
        return [spaced] * bool(p.get("add_prefix_space")) + [Stage("(?U)" + BYTE_LEVEL_PATTERN)] * bool(p.get("use_regex", True)), ""
    if kind == "Whitespace":
        return [Stage(r"(?U)\w+|[^\w\s]+", keep="matches")], ""
    if kind == "WhitespaceSplit":
        return [Stage(r"(?U)\s+", keep="gaps")], ""
    if kind == "BertPreTokenizer":
        return [Stage(r"(?U)\s", keep="gaps"), Stage(BERT_PUNCTUATION)], ""
    if kind == "Punctuation" and p.get("behavior", "Isolated") == "Isolated":
        return [Stage(BERT_PUNCTUATION)], ""
    if kind == "Digits":
        return [Stage(r"\p{N}" if p.get("individual_digits") else r"\p{N}+")], ""
    if kind == "Metaspace":
        mark, scheme = p.get("replacement", "\u2581"), p.get("prepend_scheme", "always")

        def marked(t: Column) -> Column:
            plain = F.translate(t, " ", mark)
            return plain if scheme == "never" else F.when((plain == "") | plain.startswith(mark), plain).otherwise(F.concat(F.lit(mark), plain))

        rewrite = [Stage(steps=(lambda t: F.translate(t, " ", mark),)), Stage(steps=(marked,), first_only=True)] if scheme == "first" else [Stage(steps=(marked,))]
        return rewrite + [Stage(f"{java_literal(mark)}[^{java_literal(mark)}]*")] * bool(p.get("split", True)), ""
    return [], f"pre-tokenizer {kind}"


def _may_be_empty(pattern: str) -> bool:
    """Whether a pattern may match the empty string (unknown syntax counts as yes)."""
    plain = re.sub(r"\\[pP]\{\^?\w+\}|\\[pP]\w", "[a]", pattern)
    plain = re.sub(r"\[((?:[^\[\]\\]|\\.|\[a\])*)\]", "[a]", plain)
    plain = re.sub(r"\\x\{[0-9A-Fa-f]+\}", "a", plain)
    try:
        compiled = re.compile(plain)
    except re.error:
        return True
    alternatives_only_look = re.search(r"(^|[|(])\(\?[=!<]", plain) is not None
    return compiled.match("") is not None or alternatives_only_look


def _cut(text: Column, stage: Stage) -> Column:
    """Matches of the stage's pattern, the text between them, or both, in order."""
    gap = f"(?:(?!{stage.pattern})(?s:.))++"
    found = {"all": f"(?:{stage.pattern})|{gap}", "matches": stage.pattern, "gaps": gap}[stage.keep]
    return F.regexp_extract_all(text, F.lit(found), 0)


def split_pieces(df: DataFrame, spec: TokenizerSpec, text_col: str = "text", keep: tuple[str, ...] = (), position: str | None = None) -> DataFrame:
    """One row per piece, ``(*keep, [position,] piece, is_added)``, cut as the tokenizer does.

    ``position`` names a column that orders the pieces of a row.
    """
    last = spec.stages[-1] if spec.stages else None
    if not position and last is not None and not last.steps and not last.final:
        # The last cut makes most of the pieces: it gives plain strings, a part of a text a row.
        rows, items, _ = _piece_items(df, replace(spec, stages=spec.stages[:-1]), text_col, keep)
        parts = rows.select(*keep, F.explode(items).alias("_x"))
        found = F.when(F.col("_x.a"), F.array("_x.t")).otherwise(_cut(F.col("_x.t"), last))
        return parts.select(*keep, F.explode(found).alias("piece"), F.col("_x.a").alias("is_added")).filter("piece <> ''")
    rows, items, part = _piece_items(df, spec, text_col, keep)
    if position:
        rows = rows.select(*keep, part.alias("_p"), F.posexplode(items).alias("_q", "_x"))
        place = F.col("_p").cast("long") * (1 << 32) + F.col("_q")
        return rows.select(*keep, place.alias(position), F.col("_x.t").alias("piece"), F.col("_x.a").alias("is_added"))
    return rows.select(*keep, F.explode(items).alias("_x")).select(*keep, F.col("_x.t").alias("piece"), F.col("_x.a").alias("is_added"))


def _piece_items(df: DataFrame, spec: TokenizerSpec, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, Column, Column]:
    """Rows with, as columns, an array of pieces ``(t, a)`` and the row's place among those of its text (one row a text unless a stage works by row)."""
    if spec.stages is None:
        raise ValueError(f"the tokenizer's split cannot be reproduced: {spec.reason}")
    whole = F.struct(F.col(text_col).alias("t"), F.lit(False).alias("a"))
    rows, items, part = df, F.array(whole), F.lit(0)
    for stage in spec.stages:
        if _by_row(stage):
            # Unicode forms are computed in a projection, one text a row.
            rows = rows.select(*keep, F.posexplode(items).alias("_part", "_x"))
            text = F.when(F.col("_x.a"), F.col("_x.t")).otherwise(normalized(F.col("_x.t"), list(stage.steps)))
            rows = rows.select(*keep, "_part", F.array(F.struct(text.alias("t"), F.col("_x.a").alias("a"))).alias("_items"))
            items, part = F.col("_items"), F.col("_part")
        else:
            items = _next(items, stage, part)
    return rows, F.filter(items, lambda x: x["t"] != ""), part


def _by_row(stage: Stage) -> bool:
    return any(getattr(step, "by_row", False) for step in stage.steps)


def _next(items: Column, stage: Stage, part: Column) -> Column:
    if stage.steps:

        def rewrite(x: Column, i: Column) -> Column:
            skip = x["a"] | ((part + i) > 0) if stage.first_only else x["a"]
            return F.struct(F.when(skip, x["t"]).otherwise(normalized(x["t"], list(stage.steps))).alias("t"), x["a"].alias("a"))

        return F.transform(items, rewrite)

    def cut(x: Column) -> Column:
        parts = F.transform(_cut(x["t"], stage), lambda t: F.struct(t.alias("t"), (t.rlike(rf"\A(?:{stage.pattern})\z") if stage.final else F.lit(False)).alias("a")))
        # Added tokens are rare: a text without one is left whole, not cut character by character.
        whole = x["a"] | ~x["t"].rlike(stage.pattern) if stage.final else x["a"]
        return F.when(whole, F.array(x)).otherwise(parts)

    return F.flatten(F.transform(items, cut))


def piece_counts(df: DataFrame, spec: TokenizerSpec, text_col: str = "text") -> DataFrame:
    """``(piece, is_added, n)``: how often each distinct piece occurs (T3, first half)."""
    return split_pieces(df, spec, text_col).groupBy("piece", "is_added").agg(F.count(F.lit(1)).alias("n"))


# -- models as joins (T1, T4) ------------------------------------------------------


def bpe_tokens(pieces: DataFrame, spec: TokenizerSpec, merges: DataFrame, vocab: DataFrame, is_spelled: bool = False) -> DataFrame:
    """T4: add ``tokens array<string>`` to distinct pieces ``(piece, is_added, ...)``, already in the model's alphabet if ``is_spelled``.

    A merge can only apply to a piece that contains its result, so the
    substrings of each piece (up to the longest token) are equi-joined with the
    results of all merges; the few hits, by rank, are then folded over the
    piece. The cost of a piece depends on its length, not on the number of merges,
    and ``pieces`` is computed once.
    That is exact where every merge comes after those that make its parts
    (``spec.ordered``, checked when the file is read); other merge lists are
    run pair by pair in an Arrow function (``model_tokens``).
    """
    if not spec.native:
        raise ValueError(f"byte-pair encoding in Spark does not cover {spec.reason}")
    opens, closes, _ = spec.marks
    base = pieces.withColumn("spelled", F.col("piece") if is_spelled else _spelled(spec)).withColumn("n_c", F.when(F.col("is_added"), F.lit(0)).otherwise(F.length("spelled")))
    chars = F.filter(F.split("spelled", ""), lambda c: c != "")
    if spec.suffix:
        chars = F.transform(chars, lambda c, i: F.when(i + 1 == F.col("n_c"), F.concat(c, F.lit(spec.suffix))).otherwise(c))
    if spec.ordered:
        # A merge list has at most as many rows as its vocabulary; the hint is given only below the checked bound.
        pair, joined = F.concat(F.lit(opens), "left", F.lit(closes + opens), "right", F.lit(closes)), F.concat(F.lit(opens), "left", "right", F.lit(closes))
        rules = bounded_broadcast(merges.select(F.concat("left", "right").alias("_result"), "rank", pair.alias("pair"), joined.alias("joined")).withColumn("_h", F.xxhash64("_result")))
        # One pass over the pieces. A group is a piece, a long one by its digest; the piece's own columns ride on its head row only.
        is_long = F.col("n_c") > LONG
        keys = [F.when(~is_long, F.col("piece")).alias("_short"), F.when(is_long, F.sha2(F.col("piece").cast("binary"), 256)).alias("_long")]
        columns = [*pieces.columns, "spelled", "n_c"]
        places = substrings(stretches(base.select(*keys, F.struct(*columns).alias("_own"), "spelled", "n_c"), spec.max_token_chars), 2, spec.max_token_chars, suffix=spec.suffix)
        # Probed on a 64-bit hash, then compared; a row that stands for its piece has no place and finds nothing.
        same = (F.col("h") == F.col("_h")) & F.coalesce(F.col("whole") == F.col("_result"), F.lit(False))
        rows = places.withColumn("h", F.xxhash64("whole")).join(rules, same, "left").filter("rank is not null or (is_head and i = 0)")
        own = F.when(F.col("is_head") & (F.col("i") == 0), F.col("_own"))
        rows = rows.select("_short", "_long", F.col("_own.is_added").alias("_added"), own.alias("_own"), F.when(F.col("rank").isNotNull(), F.struct("rank", "pair", "joined")).alias("_rule"))
        found = rows.groupBy("_short", "_long", "_added").agg(F.first("_own", ignorenulls=True).alias("_own"), F.array_sort(F.collect_set("_rule")).alias("rules"))
        both = found.select("_own.*", "rules").withColumn("c", chars)
        wrapped = F.concat(F.lit(opens), F.array_join("c", closes + opens), F.lit(closes))
        done = F.btrim(F.aggregate("rules", wrapped, lambda acc, m: F.replace(acc, m["pair"], m["joined"])), F.lit(opens + closes))
        tokens = F.when(F.col("n_c") == 1, F.col("c")).otherwise(F.split(done, closes + opens))
        out = both.withColumn("tokens", tokens)
    else:
        out = model_tokens(base, spec)
    out = out.withColumn("tokens", F.when(F.col("is_added"), F.array("piece")).otherwise(F.col("tokens")))
    if spec.ignore_merges:
        # A piece that is a token is taken whole.
        known = bounded_broadcast(vocab.filter(~F.col("special")).select(F.col("token").alias("_whole"))).distinct()
        out = out.join(known, F.col("spelled") == F.col("_whole"), "left")
        out = out.withColumn("tokens", F.when(F.col("_whole").isNotNull() & ~F.col("is_added"), F.array("spelled")).otherwise(F.col("tokens")))
    return out.select(*pieces.columns, "tokens")


def _spelled(spec: TokenizerSpec) -> Column:
    """``piece`` in the model's alphabet."""
    opens, closes, other = spec.marks
    return to_byte_level(F.col("piece")) if spec.byte_level else F.translate(F.col("piece"), opens + closes, other * 2)


def stretch_counts(counts: DataFrame, spec: TokenizerSpec) -> DataFrame:
    """``(piece, is_added, n)`` of the spelled stretches between borders that no token holds, from ``piece_counts``.

    Their tokens are those of the pieces, and there are far fewer different ones.
    """
    parts = F.when(F.col("is_added"), F.array("piece")).otherwise(F.regexp_extract_all("spelled", F.lit(spec.stretch), 0))
    rows = counts.withColumn("spelled", _spelled(spec)).select("is_added", "n", F.explode(parts).alias("piece"))
    return rows.groupBy("piece", "is_added").agg(F.sum("n").alias("n"))


def piece_tokens(pieces: DataFrame, spec: TokenizerSpec, merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``tokens array<string>`` to distinct pieces by the tokenizer's model."""
    if not spec.native:
        raise ValueError(f"encoding in Spark does not cover {spec.reason}")
    if spec.model in ("WordPiece", "Unigram"):
        tokens = model_tokens(pieces.withColumn("spelled", F.when(F.col("is_added"), "").otherwise(F.col("piece"))), spec)
        return tokens.select(*pieces.columns, F.when(F.col("is_added"), F.array("piece")).otherwise(F.col("tokens")).alias("tokens"))
    return bpe_tokens(pieces, spec, merges, vocab)


def _with_ids(rows: DataFrame, spec: TokenizerSpec, vocab: DataFrame) -> DataFrame:
    """Rows of ``token, is_added`` with ``token_id`` (the unknown token's where the vocabulary lacks it)."""
    plain = vocab.filter(~F.col("special")).select("token", F.lit(False).alias("is_added"), "token_id")
    # Added tokens win on their own text only.
    listed = F.from_json(F.lit(json.dumps([{"token": t, "token_id": i} for t, i in spec.added.items()])), "array<struct<token:string,token_id:int>>")
    special = vocab.sparkSession.range(1).select(F.inline(listed)).select("token", F.lit(True).alias("is_added"), "token_id")
    table = plain.join(special.select("token_id"), "token_id", "left_anti").unionByName(special) if spec.added else plain
    out = rows.join(bounded_broadcast(table), ["token", "is_added"], "left")
    out = out.withColumn("token_id", F.coalesce(F.col("token_id"), F.lit(spec.unk_id).cast("int")))
    # Without an unknown token the model drops such symbols.
    return out if spec.unk_id is not None else out.filter(F.col("token_id").isNotNull())


def bpe_ids(pieces: DataFrame, spec: TokenizerSpec, merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``ids array<int>`` to distinct pieces ``(piece, is_added, ...)``."""
    tokens = piece_tokens(pieces, spec, merges, vocab)
    return tokens_to_ids(tokens, spec).select(*pieces.columns, "ids")


def bpe_frequency(counts: DataFrame, spec: TokenizerSpec, merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """A1: ``(token_id, count)`` from ``piece_counts``."""
    if spec.native and spec.stretch:
        tokens = bpe_tokens(stretch_counts(counts, spec), spec, merges, vocab, is_spelled=True)
    else:
        tokens = piece_tokens(counts, spec, merges, vocab)
    rows = _with_ids(tokens.select("is_added", "n", F.explode("tokens").alias("token")), spec, vocab)
    return rows.groupBy("token_id").agg(F.sum("n").cast("long").alias("count"))


#: Characters up to which a text is encoded in its row.
ROW_CHARS = 1 << 20


def encode_documents(docs: DataFrame, spec: TokenizerSpec, merges: DataFrame, vocab: DataFrame, key: str = "doc_id", text_col: str = "text", add_special_tokens: bool = False) -> DataFrame:
    """``(key, ids array<int>)`` of every text, in order.

    A text of up to ``ROW_CHARS`` characters is split and encoded in its row;
    a task runs the model once for each distinct piece, and nothing but rows whose
    normalizer works by row is shuffled. Longer texts, and texts whose key
    repeats (their pieces go together), are encoded by distinct pieces: pieces carry their
    position and the ids are joined back. A row's ids are one list, as in any whole-text encoding,
    between those of the post-processor's template if special tokens are asked for.
    """
    parts, plain = [], docs.filter(F.col(key).isNotNull() & F.coalesce(F.length(text_col) <= ROW_CHARS, F.lit(True)))
    others = docs.filter(F.col(key).isNull() | (F.length(text_col) > ROW_CHARS))
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    if not repeated.isEmpty():
        twice = docs.filter(F.col(key).isNotNull()).join(repeated, key, "left_semi")
        plain = plain.join(repeated, key, "left_anti")
        others = others.join(repeated, key, "left_anti").unionByName(twice)
    parts.append(_encoded_in_rows(plain, spec, key, text_col))
    if not others.select(key).isEmpty():
        parts.append(_encoded_by_pieces(others, spec, merges, vocab, key, text_col))
    out = reduce(DataFrame.unionByName, parts)
    if not add_special_tokens:
        return out
    around = [F.array(*[F.lit(i) for i in part]).cast("array<int>") for part in (spec.before, spec.after)]
    return out.select(key, F.concat(around[0], "ids", around[1]).alias("ids"))


def _encoded_in_rows(docs: DataFrame, spec: TokenizerSpec, key: str, text_col: str) -> DataFrame:
    """``(key, ids)`` of texts with unique keys."""
    if not spec.native:
        raise ValueError(f"encoding in Spark does not cover {spec.reason}")
    ship_package(docs.sparkSession)
    rows, items, part = _piece_items(docs.select(key, text_col), spec, text_col, (key,))
    rows = rows.select(key, part.alias("_p"), items.alias("_pieces"))
    rows = rows.withColumn("ids", pieces_to_ids(spec, F.col("_pieces.t"), F.col("_pieces.a")))
    if not any(map(_by_row, spec.stages)):
        return rows.select(key, "ids")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "ids"))).alias("x"))
    out = docs.select(key).join(lists, key, "left")
    return out.select(key, F.coalesce(F.flatten(F.transform("x", lambda e: e["ids"])), F.array().cast("array<int>")).alias("ids"))


def _encoded_by_pieces(docs: DataFrame, spec: TokenizerSpec, merges: DataFrame, vocab: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, ids)`` by distinct pieces; the pieces of rows with one key go together."""
    pieces = split_pieces(docs, spec, text_col, (key,), "pos")
    encoded = bpe_ids(pieces.select("piece", "is_added").distinct(), spec, merges, vocab)
    rows = pieces.join(encoded, ["piece", "is_added"])
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))
    out = docs.select(key).join(lists, key, "left")
    return out.select(key, F.coalesce(F.flatten(F.transform("x", lambda e: e["ids"])), F.array().cast("array<int>")).alias("ids"))
