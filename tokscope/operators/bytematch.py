"""Byte-level occurrence statistics of vocabulary entries.

Every overlapping occurrence of every pattern's bytes in every document
is found with an n-gram equi-join:

* each document (or segment of at most 4 MiB) becomes one row per byte
  position inside one codegen stage; candidates and neighbours are sliced
  from the segment bytes, which are referenced there, not copied per row;
* each position yields one candidate per length that some pattern
  starting with that position's two bytes has (a broadcast table of at
  most 65,536 + 256 rows);
* candidates are probed against the pattern table, broadcast after a size
  check (it is bounded by the vocabulary, not the corpus), on a 64-bit
  hash key with the bytes compared exactly after the probe.

Generate, probe and the partial aggregate run in one codegen stage, so
candidates are never materialised; only per-task partial counts per
``(pattern, left byte, right byte)`` reach the single shuffle. A pattern that
matches a third of the corpus is one row per task in that shuffle.
Matches never cross document boundaries (a document is the unit of work);
a very long document is cut into overlapping segments, with no occurrence
lost or counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.functions.text import (
    MEANINGLESS_ENTROPY_BELOW,
    MEANINGLESS_FREQ_BELOW,
    MEANINGLESS_RATIO_BELOW,
    STANDALONE_EPSILON,
    VISIBLE_BYTE_HIGH,
    VISIBLE_BYTE_LOW,
    byte_value,
    has_control_byte,
)
from tokscope.session import bounded_broadcast

# Patterns are broadcast only up to this many rows (checked; a 150K-entry
# vocabulary is far below it); above, the planner's shuffle join is used.
BROADCAST_MAX_PATTERNS = 5_000_000


def distinct_patterns(vocab_bytes: DataFrame) -> DataFrame:
    """Distinct non-empty ``token_bytes`` with an id ``pid`` and length ``plen``.

    The id is an int key for the match aggregate (ints hash faster than
    binaries): the smallest token id sharing those bytes, so it is
    deterministic and lets the planner reuse the match shuffle.
    """
    pats = (
        vocab_bytes.filter(F.octet_length("token_bytes") > 0)
        .groupBy("token_bytes")
        .agg(F.min("token_id").cast("int").alias("pid"))
    )
    return pats.select("pid", "token_bytes", F.octet_length("token_bytes").alias("plen"))


def max_pattern_length(patterns: DataFrame) -> int:
    """Byte length of the longest pattern (0 when there is none): one aggregated value."""
    return int(patterns.agg(F.coalesce(F.max("plen"), F.lit(0))).first()[0])


# Documents longer than this many bytes are cut into overlapping segments.
MAX_SEGMENT_BYTES = 4 * 1024 * 1024


def byte_segments(docs: DataFrame, maxlen: int, text_col: str = "text", max_segment_bytes: int = MAX_SEGMENT_BYTES) -> DataFrame:
    """``(s, lo, hi)``: byte strings and the 1-based candidate start range in each.

    ``text_col`` may be a string column (matched as UTF-8) or a binary one.

    One pass: every document is cut into pieces of ``max_segment_bytes``
    candidate starts by one generator (most have a single piece). Each segment keeps one byte of left
    context and ``maxlen`` bytes of right context, so every occurrence and
    both of its neighbours are seen exactly once, and positions are always
    generated over bounded strings.
    """
    c = max_segment_bytes
    # A binary column (raw file bytes, S2) is matched as is, invalid UTF-8 included.
    binary = dict(docs.dtypes).get(text_col) == "binary"
    whole = F.col(text_col) if binary else F.encode(F.col(text_col), "UTF-8")
    n = F.octet_length(text_col)
    pieces = F.sequence(F.lit(0), F.ceil(n / c).cast("int") - 1)
    rows = docs.filter(n > 0).select(whole.alias("b"), n.alias("n"), F.explode(pieces).alias("k"))
    k = F.col("k").cast("long")
    seg_first = k * c + 1  # first candidate start (document position)
    seg_last = F.least((k + 1) * c, F.col("n").cast("long"))
    from_pos = F.greatest(seg_first - 1, F.lit(1))  # one byte of left context
    to_pos = F.least(seg_last + maxlen, F.col("n"))  # maxlen bytes of right context
    return rows.select(
        F.substring("b", from_pos.cast("int"), (to_pos - from_pos + 1).cast("int")).alias("s"),
        (seg_first - from_pos + 1).cast("int").alias("lo"),
        (seg_last - from_pos + 1).cast("int").alias("hi"),
    )


def start_lengths(patterns: DataFrame) -> DataFrame:
    """``(k, lens)``: the pattern lengths that can start with the bytes ``k``.

    ``k`` is every 2-byte string (lengths of patterns of 2+ bytes with that
    prefix, plus 1 when the first byte alone is a pattern) and every single
    byte (for the last position of a segment: ``[1]`` when it is a
    pattern). Built from ``range(65536)`` and equi-joins; at most
    65,536 + 256 rows whatever the vocabulary size.
    """
    spark = patterns.sparkSession
    two = spark.range(65536).select(F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("k"))
    longer = patterns.filter(F.col("plen") >= 2).groupBy(F.substring("token_bytes", 1, 2).alias("k")).agg(
        F.collect_set("plen").alias("ls")
    )
    single = patterns.filter(F.col("plen") == 1).select(F.col("token_bytes").alias("b1"))
    empty = F.array().cast("array<int>")
    two_tab = (
        two.join(F.broadcast(longer), "k", "left")  # <= 65,536 distinct two-byte prefixes
        .join(F.broadcast(single), F.substring("k", 1, 1) == F.col("b1"), "left")  # <= 256 rows
        .select(
            "k",
            F.array_sort(
                F.array_union(
                    F.coalesce(F.col("ls"), empty), F.when(F.col("b1").isNotNull(), F.array(F.lit(1))).otherwise(empty)
                )
            ).alias("lens"),
        )
        .filter(F.size("lens") > 0)
    )
    one_tab = single.select(F.col("b1").alias("k"), F.array(F.lit(1)).alias("lens"))
    return two_tab.unionByName(one_tab)


def match_neighbours(docs: DataFrame, patterns: DataFrame, maxlen: int, text_col: str = "text",
                     n_patterns: int | None = None, max_segment_bytes: int = MAX_SEGMENT_BYTES) -> DataFrame:
    """One row per occurrence: ``(pid, left, right)``.

    ``left``/``right`` are the neighbour bytes as 1-byte binaries, NULL at
    a document edge (converted to ints only after aggregation). ``maxlen``
    is the longest pattern's byte length (``max_pattern_length``); it sets
    the window size.
    """
    if maxlen <= 0:
        return patterns.sparkSession.createDataFrame([], "pid int, left binary, right binary")
    segs = byte_segments(docs, maxlen, text_col, max_segment_bytes).withColumn("n", F.octet_length("s"))
    pos = segs.select("n", F.col("s").alias("b"), F.explode(F.sequence(F.col("lo"), F.col("hi"))).alias("pos"))
    # Candidates are cut straight from the segment bytes (passed by reference
    # inside the codegen stage), so no per-position window is copied.
    # Lengths of the patterns that can start at a position, looked up by the
    # position's first two bytes (one byte at a segment end) in a table of
    # at most 65,536 + 256 rows (``start_lengths``).
    starts_tab = F.broadcast(start_lengths(patterns).withColumn("kh", F.xxhash64("k")))
    key = F.substring(F.col("b"), F.col("pos"), F.lit(2))
    keyed = pos.select("n", "pos", "b", key.alias("key"), F.xxhash64(key).alias("kh"))
    starts = keyed.join(starts_tab, "kh").filter(F.coalesce(F.col("key") == F.col("k"), F.lit(False)))
    cand = starts.select("n", "pos", "b", F.explode("lens").alias("plen")).filter(
        F.col("pos") + F.col("plen") - 1 <= F.col("n")
    )
    cand = cand.select("plen", F.substring(F.col("b"), F.col("pos"), F.col("plen")).alias("token_bytes"), "b", "pos", "n")
    # Probe on a 64-bit hash of the bytes (a long key takes the planner's
    # fast hashed-relation path, ~7x faster than a binary key here), then
    # check the bytes themselves: a hash collision can never make a match.
    # The check is wrapped in coalesce so it stays a join condition instead
    # of becoming a second (binary) join key.
    cand = cand.withColumn("h", F.xxhash64("token_bytes"))
    pats = patterns.select("pid", F.col("token_bytes").alias("pattern_bytes"), F.xxhash64("token_bytes").alias("h"))
    pats = bounded_broadcast(pats, BROADCAST_MAX_PATTERNS, n_patterns)
    same_bytes = F.coalesce(F.col("token_bytes") == F.col("pattern_bytes"), F.lit(False))
    matched = cand.join(pats, "h").filter(same_bytes)
    # Neighbours are cut only for the candidates that matched.
    return matched.select(
        "pid",
        F.when(F.col("pos") > 1, F.substring(F.col("b"), F.col("pos") - 1, F.lit(1))).alias("left"),
        F.when(
            F.col("pos") + F.col("plen") <= F.col("n"), F.substring(F.col("b"), F.col("pos") + F.col("plen"), F.lit(1))
        ).alias("right"),
    )


def neighbour_pairs(matches: DataFrame) -> DataFrame:
    """A3-A5 in one aggregate: ``(pid, left, right, c)`` occurrence counts.

    The only shuffle of the byte-match program. Each task first combines
    its matches per key, so at most patterns x 257 x 257 rows (in practice
    far fewer) leave a task, however hot a pattern is. Neighbours are counted
    by a number each (their 32-bit hash, different for all 256 bytes and none), on which an
    aggregate is faster than on binaries, and named afterwards from a table of 257 rows.
    """
    coded = matches.select("pid", F.hash("left").alias("left"), F.hash("right").alias("right"))
    counts = coded.groupBy("pid", "left", "right").agg(F.count(F.lit(1)).alias("c"))
    left, right = (F.broadcast(byte_codes(matches.sparkSession).toDF(f"{side}_byte", side)) for side in ("left", "right"))
    return counts.join(left, "left").join(right, "right").select("pid", F.col("left_byte").alias("left"), F.col("right_byte").alias("right"), "c")


def byte_codes(spark: SparkSession) -> DataFrame:
    """``(byte, code)`` of all 256 one-byte binaries and of null."""
    byte = F.when(F.col("id") < 256, F.unhex(F.lpad(F.hex("id"), 2, "0")))
    return spark.range(257).select(byte.alias("byte")).select("byte", F.hash("byte").alias("code"))


def _visible(b) -> F.Column:
    return (b >= F.lit(bytes([VISIBLE_BYTE_LOW]))) & (b <= F.lit(bytes([VISIBLE_BYTE_HIGH])))


def _standalone(pairs_left: F.Column, pairs_right: F.Column) -> F.Column:
    return pairs_left.isNotNull() & pairs_right.isNotNull() & ~_visible(pairs_left) & ~_visible(pairs_right)


def side_histogram(pairs: DataFrame) -> DataFrame:
    """A5: ``(pid, side, byte, c, s)``; ``byte`` NULL counts occurrences at an edge.

    ``s`` (standalone occurrences) rides on the ``L`` rows only, so
    per-pattern sums over this table are exact.
    """
    s = F.when(_standalone(F.col("left"), F.col("right")), F.col("c")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.lit("L").alias("side"), F.col("left").alias("nb"), s.alias("s")),
        F.struct(F.lit("R").alias("side"), F.col("right").alias("nb"), F.lit(0).cast("long").alias("s")),
    )
    rows = pairs.select("pid", "c", F.inline(sides))
    return rows.groupBy("pid", "side", byte_value(F.col("nb"), 1).alias("byte")).agg(
        F.sum("c").alias("c"), F.sum("s").alias("s")
    )


def byte_token_frequency(pairs: DataFrame) -> DataFrame:
    """A3 + A4: ``(pid, freq, standalone)`` per matched pattern."""
    standalone = _standalone(F.col("left"), F.col("right"))
    return pairs.groupBy("pid").agg(
        F.sum("c").cast("long").alias("freq"),
        F.coalesce(F.sum(F.when(standalone, F.col("c"))), F.lit(0)).cast("long").alias("standalone"),
    )


def neighbor_counts(pairs: DataFrame) -> DataFrame:
    """A5: ``(pid, side, byte, count)`` for present neighbours."""
    hist = side_histogram(pairs)
    return hist.filter(F.col("byte").isNotNull()).select("pid", "side", "byte", F.col("c").cast("long").alias("count"))


def neighbor_entropy(pairs: DataFrame) -> DataFrame:
    """Base-2 entropy of the left and right histograms taken together.

    ``H = log2(T) - sum(c log2 c) / T``; patterns with no neighbour are absent
    here and get 0 in ``token_metrics``.
    """
    nb = neighbor_counts(pairs)
    agg = nb.groupBy("pid").agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.log2(F.col("count"))).alias("clc"))
    return agg.select("pid", (F.log2("t") - F.col("clc") / F.col("t")).alias("entropy"))


def pattern_stats(pairs: DataFrame, patterns: DataFrame, n_patterns: int | None = None) -> DataFrame:
    """A3, A4, A6 per pattern: ``(token_bytes, freq, standalone, entropy)``.

    One linear chain over the (small) side histogram, so the match and its
    shuffle run once.
    """
    hist = side_histogram(pairs)
    nb = F.col("byte").isNotNull()
    agg = hist.groupBy("pid").agg(
        F.sum(F.when(F.col("side") == "L", F.col("c"))).cast("long").alias("freq"),
        F.sum("s").cast("long").alias("standalone"),
        F.sum(F.when(nb, F.col("c"))).alias("t"),
        F.sum(F.when(nb, F.col("c") * F.log2(F.col("c")))).alias("clc"),
    )
    ent = F.when(F.col("t") > 0, F.log2("t") - F.col("clc") / F.col("t")).otherwise(F.lit(0.0))
    pats = bounded_broadcast(patterns.select("pid", "token_bytes"), BROADCAST_MAX_PATTERNS, n_patterns)
    return agg.join(pats, "pid").select(
        "token_bytes", "freq", "standalone", ent.alias("entropy")
    )


def token_metrics(vocab_bytes: DataFrame, stats: DataFrame) -> DataFrame:
    """A9 (J5, A7, A8): one row per vocabulary entry.

    ``(token, freq_in_corpus, standalone_ratio, entropy, length_bytes,
    meaningless)``; duplicate byte strings in the vocabulary give duplicate
    rows, as in the analysed program. ``token`` is the bytes decoded with
    U+FFFD for invalid sequences.
    """
    j = vocab_bytes.select("token_id", "token_bytes", "decoded").join(stats, "token_bytes", "left")
    freq = F.coalesce(F.col("freq"), F.lit(0)).cast("long")
    stand = F.coalesce(F.col("standalone"), F.lit(0)).cast("long")
    ratio = stand / (freq + F.lit(STANDALONE_EPSILON))
    ent = F.coalesce(F.col("entropy"), F.lit(0.0))
    out = j.select(
        "token_id",
        F.col("decoded").alias("token"),
        freq.alias("freq_in_corpus"),
        ratio.alias("standalone_ratio"),
        ent.alias("entropy"),
        F.octet_length("token_bytes").cast("int").alias("length_bytes"),
        has_control_byte("token_bytes").alias("_ctrl"),
    )
    meaningless = (
        (F.col("freq_in_corpus") == 0)
        | F.col("_ctrl")
        | (
            (F.col("entropy") < MEANINGLESS_ENTROPY_BELOW)
            & (F.col("standalone_ratio") < MEANINGLESS_RATIO_BELOW)
            & (F.col("freq_in_corpus") < MEANINGLESS_FREQ_BELOW)
        )
    )
    return out.withColumn("meaningless", meaningless).drop("_ctrl")


def corpus_token_metrics(
    docs: DataFrame, vocab_bytes: DataFrame, text_col: str = "text", max_segment_bytes: int = MAX_SEGMENT_BYTES
) -> DataFrame:
    """The whole byte-match program: corpus + vocabulary -> metrics table."""
    pats = distinct_patterns(vocab_bytes)
    n = pats.count()
    pairs = neighbour_pairs(match_neighbours(docs, pats, max_pattern_length(pats), text_col, n, max_segment_bytes))
    return token_metrics(vocab_bytes, pattern_stats(pairs, pats, n))
