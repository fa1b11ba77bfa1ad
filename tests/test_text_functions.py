"""P3, P5-P9 on literal edge cases."""

from pyspark.sql import functions as F

from tokscope.functions.text import (
    CJK_RANGES,
    byte_level_to_bytes,
    contains_script,
    has_control_byte,
    replace_invalid,
)


def test_script_ranges(spark):
    rows = ["abc", " 根", chr(0x20001), "，", "é", chr(0x30000), "�"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(contains_script("t", CJK_RANGES)).collect()]
    assert got == [False, True, True, True, False, False, False]


def test_invalid_utf8_replaced(spark):
    df = spark.createDataFrame([(bytearray(b" \xe6\xa0"),), (bytearray(b" \xe6\xa0\xb9"),)], "b binary")
    got = [r[0] for r in df.select(replace_invalid("b")).collect()]
    assert got == [" �", " 根"]


def test_control_bytes(spark):
    vals = [0x00, 0x09, 0x0A, 0x0D, 0x1F]
    df = spark.createDataFrame([(i, bytearray([v])) for i, v in enumerate(vals)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(has_control_byte("b")).collect()]
    assert got == [True, False, False, False, True]


def _byte_level_alphabet():
    # The public GPT-2 rule, written independently of the Spark expression.
    keep = list(range(0x21, 0x7F)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    table, extra = {}, 0
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


def test_byte_level_round_trip_all_bytes(spark):
    table = _byte_level_alphabet()
    text = "".join(table[b] for b in range(256))
    df = spark.createDataFrame([(text,)], "t string")
    got = bytes(df.select(byte_level_to_bytes("t")).first()[0])
    assert got == bytes(range(256))


def test_byte_level_partial_tokens_collapse(spark):
    from tokscope.sources.vocab import vocab_with_bytes

    table = _byte_level_alphabet()
    toks = ["".join(table[b] for b in bs) for bs in (b" \xe6\xa0", b" \xe6\xa0\xb9", b"\xe6", b"\xa0")]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(toks)], "token_id int, token string, special boolean")
    out = vocab_with_bytes(df, "byte_level").orderBy("token_id").select("decoded", F.hex("token_bytes")).collect()
    assert [r[0] for r in out] == [" �", " 根", "�", "�"]
    assert out[2][1] == out[3][1] == "EFBFBD"
