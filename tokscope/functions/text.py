"""Column expressions over text and bytes (P3, P5-P9, scalar helpers).

Everything here returns a ``Column`` built from ``pyspark.sql.functions``,
so it runs inside whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the analysed program's values for results
# to match; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

# Code-point ranges of the "Chinese token" test (inclusive bounds):
# CJK Unified Ideographs Extension A, CJK Unified Ideographs, CJK
# Compatibility Ideographs, Extensions B, C, D, E, F, CJK Symbols and
# Punctuation, Halfwidth and Fullwidth Forms.
CJK_RANGES: tuple[tuple[int, int], ...] = (
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0x2CEB0, 0x2EBEF),
    (0x3000, 0x303F),
    (0xFF00, 0xFFEF),
)

# Latin-1 letters: the range used on the driver tables, which hold no CJK.
LATIN1_LETTER_RANGES: tuple[tuple[int, int], ...] = ((0x00C0, 0x00FF),)

# Control bytes that mark a token as meaningless (tab, LF, CR are allowed).
CONTROL_BYTE_CLASS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

# A neighbour byte is "visible" when 32 <= b <= 126 (space included).
VISIBLE_BYTE_LOW = 0x20
VISIBLE_BYTE_HIGH = 0x7E

# Meaningless rule: freq == 0, or a control byte, or
# (entropy < 0.5 and standalone ratio < 0.05 and freq < 10).
MEANINGLESS_ENTROPY_BELOW = 0.5
MEANINGLESS_RATIO_BELOW = 0.05
MEANINGLESS_FREQ_BELOW = 10

# standalone_ratio = standalone / (freq + 1e-6)
STANDALONE_EPSILON = 1e-6

# Sort key used for the survival ratio when freq + descendant_freq == 0.
SURVIVAL_SENTINEL = -1e8

# Pre-token pattern of the fixture vocabulary. It has no look-around, so
# Java regex (Spark), RE2 (DuckDB) and Oniguruma (tokenizers) agree on it.
PRETOKEN_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def _java_class(ranges: Sequence[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def script_class(ranges: Sequence[tuple[int, int]] = CJK_RANGES) -> str:
    """Java regex character class for a list of inclusive code-point ranges."""
    return _java_class(ranges)


def contains_script(col: Column | str, ranges: Sequence[tuple[int, int]] = CJK_RANGES) -> Column:
    """True if any character of ``col`` lies in one of ``ranges``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(script_class(ranges))


def utf8_bytes(col: Column | str) -> Column:
    """Text to UTF-8 bytes (BinaryType)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.encode(c, "UTF-8")


def byte_length(col: Column | str) -> Column:
    """Length in bytes of a binary or string column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.octet_length(c)


def has_control_byte(bytes_col: Column | str) -> Column:
    """Any byte in 00-08, 0B, 0C, 0E-1F.

    Bytes are viewed one-to-one as Latin-1 characters so the regex sees
    raw byte values, as the analysed program does.
    """
    c = F.col(bytes_col) if isinstance(bytes_col, str) else bytes_col
    return F.decode(c, "ISO-8859-1").rlike(CONTROL_BYTE_CLASS)


def byte_value(bytes_col: Column | str, pos: Column | int) -> Column:
    """Unsigned value (0-255) of the byte at 1-based ``pos``; NULL past the end."""
    c = F.col(bytes_col) if isinstance(bytes_col, str) else bytes_col
    one = F.substring(c, pos, 1) if isinstance(pos, int) else F.substring(c, pos, F.lit(1))
    return F.when(F.octet_length(one) == 1, F.conv(F.hex(one), 16, 10).cast("int"))


def replace_invalid(bytes_col: Column | str) -> Column:
    """Bytes to text, invalid UTF-8 sequences replaced by U+FFFD."""
    c = F.col(bytes_col) if isinstance(bytes_col, str) else bytes_col
    return F.make_valid_utf8(c.cast("string"))


def byte_level_to_bytes(token_col: Column | str) -> Column:
    """Undo the byte-level BPE alphabet: each character stands for one byte.

    The alphabet follows the public GPT-2 rule: bytes 0x21-0x7E, 0xA1-0xAC
    and 0xAE-0xFF are their own code point; the remaining 68 bytes, in
    increasing order, are shifted to code points 256, 257, ... So a code
    point ``cp >= 256`` stands for the ``(cp - 256)``-th byte of that list:
    0x00-0x20 (33 bytes), then 0x7F-0xA0 (34 bytes), then 0xAD.
    """
    c = F.col(token_col) if isinstance(token_col, str) else token_col
    chars = F.split(c, "")

    def to_byte(ch: Column) -> Column:
        cp = F.ascii(ch)
        k = cp - 256
        b = (
            F.when(cp < 256, cp)
            .when(k <= 32, k)
            .when(k <= 66, k - 33 + 0x7F)
            .otherwise(F.lit(0xAD))
        )
        return F.lpad(F.hex(b), 2, "0")

    return F.unhex(F.array_join(F.transform(chars, to_byte), ""))


def to_byte_level(text_col: Column | str) -> Column:
    """Text in the byte-level alphabet: each UTF-8 byte becomes one character.

    The inverse of ``byte_level_to_bytes`` (same public rule): bytes
    0x21-0x7E, 0xA1-0xAC and 0xAE-0xFF keep their value as code point;
    0x00-0x20 map to 256-288, 0x7F-0xA0 to 289-322 and 0xAD to 323. Bytes
    are read as Latin-1, one character each, and the 68 moved ones translated.
    """
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return bytes_to_byte_level(F.encode(c, "UTF-8"))


def bytes_to_byte_level(raw: Column) -> Column:
    """Bytes in the byte-level alphabet (see ``to_byte_level``)."""
    moved = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, moved)), "".join(chr(256 + i) for i in range(len(moved))))
