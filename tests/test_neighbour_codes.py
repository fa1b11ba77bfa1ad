"""Neighbour bytes counted by a number each."""

from tokscope.operators.bytematch import byte_codes, neighbour_pairs


def test_neighbours_are_counted_by_numbers(spark):
    codes = byte_codes(spark).collect()
    assert len({r.code for r in codes}) == 257 and {None if r.byte is None else bytes(r.byte) for r in codes} == {None, *(bytes([b]) for b in range(256))}
    rows = [(1, bytearray([b]), None) for b in range(256)] * 2 + [(1, None, bytearray(b"x")), (2, None, None)]
    pairs = neighbour_pairs(spark.createDataFrame(rows, "pid int, left binary, right binary"))
    side = lambda v: None if v is None else bytes(v)
    got = {(r.pid, side(r.left), side(r.right)): r.c for r in pairs.collect()}
    assert got == {**{(1, bytes([b]), None): 2 for b in range(256)}, (1, None, b"x"): 1, (2, None, None): 1}
