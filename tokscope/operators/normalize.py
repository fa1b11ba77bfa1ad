"""Normalizer chains of tokenizer files as column expressions.

Each step is one expression over a text column. Unicode forms come from the
ICU library that Spark ships with, called through ``java_method`` in a
projection of its own (texts that are pure ASCII skip the call); everything else is built-in functions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CJK ideograph blocks that the public BERT normalizer sets apart.
IDEOGRAPHS = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B920}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"

Step = Callable[[Column], Column]


class Unsupported(ValueError):
    """What a chain holds that cannot be reproduced exactly."""


def java_literal(text: str) -> str:
    """A Java regex that matches ``text`` itself."""
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):X}}}" for c in text)


def _replacement(text: str) -> str:
    """``text`` as the replacement of a Java regex."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def unicode_form(form: str) -> Step:
    """NFC, NFD, NFKC or NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise Unsupported(f"normalizer {form}")
    method = "compose" if form.endswith("C") else "decompose"

    def apply(text: Column) -> Column:
        call = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit("K" in form))
        return F.when(text.isNull() | (F.octet_length(text) == F.length(text)), text).otherwise(call)

    apply.by_row = True
    return apply


def lower(text: Column) -> Column:
    """Lower case of each character by itself: a final capital sigma is not special."""
    return F.lower(F.translate(text, "Σ", "σ"))


def _regex(pattern: str, content: str) -> Step:
    return lambda text: F.regexp_replace(text, pattern, _replacement(content))


def _bert(conf: dict) -> list[Step]:
    steps: list[Step] = []
    if conf.get("clean_text", True):
        steps.append(_regex("[\\x{0}\\x{FFFD}]|[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cn}&&[^\\t\\n\\r]]", ""))
        steps.append(_regex("(?U)\\s", " "))
    if conf.get("handle_chinese_chars", True):
        steps.append(lambda text: F.regexp_replace(text, f"([{IDEOGRAPHS}])", " $1 "))
    strip = conf.get("strip_accents")
    if strip if strip is not None else conf.get("lowercase", True):
        steps += [unicode_form("NFD"), _regex("\\p{Mn}", "")]
    if conf.get("lowercase", True):
        steps.append(lower)
    return steps


def _strip(conf: dict) -> list[Step]:
    left, right = conf.get("strip_left", True), conf.get("strip_right", True)
    ends = ["\\A\\s+"] * bool(left) + ["\\s+\\z"] * bool(right)
    return [_regex("(?U)" + "|".join(ends), "")] if ends else []


def _replace(conf: dict) -> list[Step]:
    pattern = conf.get("pattern", {})
    found = "(?U)" + pattern["Regex"] if "Regex" in pattern else java_literal(pattern.get("String", ""))
    if found in ("", "(?U)"):
        raise Unsupported("a replaced pattern that is empty")
    return [_regex(found, conf.get("content", ""))]


def chain(conf: dict | None) -> list[Step]:
    """The steps of a ``normalizer`` entry, in order; raises ``Unsupported`` on what cannot be reproduced."""
    if conf is None:
        return []
    kind = conf.get("type")
    if kind == "Sequence":
        return [step for part in conf.get("normalizers", []) for step in chain(part)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [unicode_form(kind)]
    if kind == "Lowercase":
        return [lower]
    if kind == "StripAccents":
        return [_regex("\\p{Mn}", "")]
    if kind == "Strip":
        return _strip(conf)
    if kind == "Replace":
        return _replace(conf)
    if kind == "Prepend":
        mark = conf.get("prepend", "")
        return [lambda text: F.when(text == "", text).otherwise(F.concat(F.lit(mark), text))]
    if kind == "BertNormalizer":
        return _bert(conf)
    raise Unsupported(f"normalizer {kind}")


def normalized(text: Column, steps: list[Step]) -> Column:
    for step in steps:
        text = step(text)
    return text


def strip_marks(text: str) -> str:
    """The driver-side form of a lower-casing, accent-stripping chain, for vocabulary rules."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
