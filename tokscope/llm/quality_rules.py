"""Line-first quality rules (DataFrame operations only, no shuffle).

Every line of a document is judged on its own by punctuation, navigation
and boilerplate rules; failing lines are removed, and a document that loses
too much of its text is rejected. Document-level base counts (symbols,
duplicate lines, repeated three-word windows) are computed next to it. All
work happens inside the row, so the operator is one scan without exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokscope.llm.common import SPACE_CLASS

# Fixed by the result contract.
SYMBOLS = r"[#*$%&|<>]"

#: Phrases of licence, cookie, subscription and rights notices.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "accept cookies", "released under the", "licensed under", "subscribe to our", "sign up for", "click here",
    "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité",
    "todos los derechos reservados", "política de privacidad", "lorem ipsum", "enable javascript",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict."""

    #: A line fails with more runs of two or more marks (``#*$%&<>`` or ``!?``) than this share of its words.
    max_marked_words: float = 0.3
    #: A line with at least this many separators (``|``, ``»``, ``›``, ``·``), at least one per four words, is navigation.
    min_separators: int = 2
    #: A line in which one word makes up more than this share of at least ten words is a word list.
    max_same_word: float = 0.5
    #: A line with a phrase of ``BOILERPLATE`` per so many characters is boilerplate.
    chars_per_phrase: int = 400
    #: A document is rejected when removed lines hold more than this share of its word characters.
    max_lost: float = 0.5


def words_of(text: Column) -> Column:
    """Words: runs of characters outside white space."""
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def _failed_line(rules: LineRules) -> str:
    """SQL expression over the line variable ``x``: true if a rule fails."""
    list_of = f"split(trim(x), '{SPACE_CLASS}+')".replace("\\", "\\\\")
    words = f"size({list_of})"
    marked = r"regexp_count(x, '[#*$%&<>]{2,}|[!?]{2,}')"
    seps = r"regexp_count(x, '[|»›·]')"
    phrases = "|".join(BOILERPLATE)
    punctuation = f"{marked} > {rules.max_marked_words} * {words}"
    navigation = f"({seps} >= {rules.min_separators} and {seps} * 4 >= {words})"
    boilerplate = f"(x rlike '(?i)({phrases})' and regexp_count(x, '(?i)({phrases})') * {rules.chars_per_phrase} > length(x))"
    # A word that is more than half of a line is the middle one of its sorted words.
    same = f"transform(array(sort_array({list_of})), w -> size(filter(w, y -> y = w[cast(size(w) div 2 as int)])))[0]"
    word_list = f"({words} >= 10 and {same} > {rules.max_same_word} * {words})"
    return f"({punctuation} or {navigation} or {boilerplate} or {word_list})"


def _repeated_words(hashes: str) -> str:
    """SQL expression: words inside 3-word windows found twice or more, the first included.

    ``hashes`` is the array of word hashes. Windows are sorted by hash; equal
    neighbours are repeats. The words they cover follow from the sorted
    start positions: each adds up to three words, less the overlap with the next.
    """
    return f"""
    aggregate(
      transform(
        array(sort_array(transform(filter(
          transform(array(sort_array(transform({hashes}, (v, i) -> struct(v, i)))),
            s -> transform(s, (e, i) -> if((i > 0 and s[i - 1].v = e.v) or (i + 1 < size(s) and s[i + 1].v = e.v), e.i, -1)))[0],
          p -> p >= 0), p -> p))),
        q -> aggregate(transform(q, (p, i) -> if(i + 1 < size(q), least(3, q[i + 1] - p), 3)), 0, (a, d) -> a + d)),
      0, (a, d) -> a + d)"""


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Judge every document; one row in, one row out.

    ``docs`` needs ``doc_id`` and ``text``; every other column passes through,
    except that columns named like a result are replaced. Adds ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``base_failed``, ``lost_share`` (share of word characters on removed
    lines), ``clean_text`` (lines that passed, joined by newline) and ``kept``.

    Edge cases: a null or empty text has no words, fails the base rules and is
    not kept; ``clean_text`` is ''. Lines without words pass. Rows repeated
    under one id are judged each by itself.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "clean_text", "kept"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("__llm_t"))
    d = d.select("*", words_of(F.col("__llm_t")).alias("__llm_w"), F.split("__llm_t", "\n").alias("__llm_l"))
    d = d.select("*", F.expr("transform(__llm_w, w -> xxhash64(w))").alias("__llm_h"), F.expr(f"filter(__llm_l, x -> {_failed_line(rules)})").alias("__llm_bad"))
    tri = F.when(F.size("__llm_h") >= 3, F.expr("transform(sequence(0, size(__llm_h) - 3), i -> xxhash64(__llm_h[i], __llm_h[i + 1], __llm_h[i + 2]))"))
    d = d.select("*", tri.alias("__llm_3"))
    filled = F.expr(f"transform(filter(__llm_l, x -> x rlike '{SPACE_CLASS.replace('[', '[^')}'), x -> xxhash64(x))".replace("\\", "\\\\"))
    repeated = F.when(F.col("__llm_3").isNull() | (F.size(F.array_distinct("__llm_3")) == F.size("__llm_3")), F.lit(0)).otherwise(F.expr(_repeated_words("__llm_3")))
    d = d.select("*", filled.alias("__llm_f"), repeated.cast("long").alias("n_repeat_words"))
    chars = F.length(F.array_join("__llm_w", ""))
    bad_chars = F.length(F.regexp_replace(F.array_join("__llm_bad", ""), SPACE_CLASS, ""))
    d = d.select(
        "*",
        F.size("__llm_w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.regexp_count("__llm_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__llm_f") - F.size(F.array_distinct("__llm_f"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__llm_bad") == 0, F.lit(0)).otherwise(bad_chars).alias("__llm_lost"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    d = d.withColumn("lost_share", F.col("__llm_lost") / F.greatest("word_chars", F.lit(1)))
    clean = F.when(F.size("__llm_bad") == 0, F.col("__llm_t")).otherwise(F.expr(f"array_join(filter(__llm_l, x -> not {_failed_line(rules)}), '\n')"))
    d = d.withColumn("clean_text", clean).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost))
    return d.drop("__llm_t", "__llm_w", "__llm_l", "__llm_h", "__llm_3", "__llm_f", "__llm_bad", "__llm_lost")
