"""Queries that use a result twice work on the corpus once."""

import contextlib
import io
import re

import pytest

from tokscope.plans import queries


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["entropy_rank_curve", "distinct_pieces_sketched"])
def test_the_corpus_is_worked_on_before_its_result_is_used_twice(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not re.search(r"ReadSchema: struct<[^\n]*\btext:", _plan(df))
