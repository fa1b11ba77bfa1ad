import collections
import hashlib

from tests.llm.conftest import SF
from tokscope.llm.line_dedup import LineRuns, dedup_lines, line_hashes
from tokscope.llm.queries import op1_line_dedup

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=40, min_docs=5):
    holders = collections.defaultdict(set)
    for i, text in docs.items():
        for line in text.split("\n"):
            key = line.strip(STRIP).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        kept = [x for x in lines if last.get(x.strip(STRIP).translate(LOWER), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_against_brute_force(spark, docs):
    want = brute(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op1_line_dedup(spark, SF).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_largest_id_keeps_the_line(spark):
    line = "É Straße " + "x" * 40
    rows = [(i, f"first {i}\n\t{line.upper() if i == 3 else line} \r\nlast") for i in range(1, 7)]
    rows[2] = (3, f"first 3\n{line.replace('x', 'X')}\nlast")
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=3, fanout=2).collect()}
    assert [out[i].n_dropped for i in range(1, 7)] == [1] * 5 + [0]
    assert out[1].text == "first 1\nlast" and out[6].text == rows[5][1]


def test_capitals_outside_ascii_differ(spark):
    rows = [(i, ("É" if i % 2 else "é") + "a" * 45) for i in range(8)]
    assert all(r.n_dropped == 0 for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_runs_are_compacted_and_new_hashes_reported(spark):
    rows = [(i, "\n".join(f"line number {j} " + "y" * 40 for j in range(i, i + 3))) for i in range(9)]
    lines = line_hashes(spark.createDataFrame(rows, "doc_id long, text string"), 40)
    index = LineRuns(spark, fanout=2)
    fresh = [index.add(lines.filter(f"doc_id = {i}")).count() for i in range(9)]
    assert fresh == [3] + [1] * 8
    assert sum(len(x) for x in index.levels) <= 4 and all(len(x) < 2 for x in index.levels)
    assert index.frequent(3).count() == 7


def test_odd_rows(odd, empty):
    out = dedup_lines(odd, min_chars=5, min_docs=2)
    assert out.columns[:2] == odd.columns[:2] and "anchor" in out.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_lines == 1 and by[1].text == "" and by[7].n_lines == 4
    assert [r.n_dropped for r in rows if r.doc_id == 5] == [0, 0]  # both hold the largest id
    assert dedup_lines(empty).count() == 0
