import collections
import re

from tests.llm.conftest import SF
from tokscope.llm.quality_rules import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeated = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def judged(df):
    return {r.doc_id: r for r in quality_rules(df).collect()}


def test_base_counts_against_brute_force(spark, docs):
    got = judged(spark.read.parquet(f"{SF}/documents.parquet"))
    for i, text in docs.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i


def test_verdict_follows_the_labels(spark):
    got = judged(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    good = [got[i] for i, q in labels if q == 1 and not got[i].base_failed]
    assert good and all(r.kept for r in good)
    assert not any(got[i].kept for i, q in labels if q == 0)


def test_windows_that_overlap_themselves(spark):
    texts = ["a a a a", "a b c a b c", "x a b c y a b c z", "a b", "a b c", " ".join(["q"] * 60)]
    got = judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [got[i].n_repeat_words for i in range(6)] == [brute(t)[4] for t in texts]


PROSE = """The river turns slowly between low hills and old fields of rye.
Farmers there still mend stone walls by hand each spring, before lambs arrive.
A narrow bridge carries one road north, past an empty mill and two orchards.
In autumn, geese rest on its wide bend while fog hides most farm houses.
Children walk to school along dikes; their teacher lives beside a chapel.
Nobody remembers who planted those chestnut trees near our market square."""


def test_bad_lines_go_first(spark):
    menu = "Home | News | Sport | About | Contact"
    notice = "Please accept cookies and read our privacy policy"
    shout = "BUY!! NOW!! CHEAP!!"
    words = "word " * 11 + "and few others"
    prose = PROSE.split("\n")
    rows = [(1, "\n".join([*prose, menu, notice, shout, words])), (2, "\n".join([f"Home | {i} | Sport | About | {i}{i} | Contact | Help" for i in range(20)] + prose[:2]))]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1].kept and not got[1].base_failed and got[1].clean_text == PROSE
    assert got[2].lost_share > 0.3 and "|" not in got[2].clean_text


def test_line_rules_at_any_length(spark):
    """A phrase in a long paragraph is no boilerplate, many of them are; a word list is one at any length."""
    paragraph = " ".join(f"{x} {i}" for i, x in enumerate(PROSE.replace("\n", " ").split())) * 3
    lines = {0: paragraph + " see our privacy policy", 1: ("our privacy policy and terms of use, " * 60).strip(), 2: " ".join(["same"] * 600 + ["other"] * 599), 3: " ".join(["same"] * 600 + ["other"] * 600)}
    got = judged(spark.createDataFrame(list(lines.items()), "doc_id long, text string"))
    assert [got[i].clean_text == lines[i] for i in range(4)] == [True, False, False, True]


def test_odd_rows(odd, empty):
    rows = quality_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r.kept and r.clean_text == "" and r.n_words == 0 for r in rows if r.text in (None, ""))
    assert quality_rules(empty).count() == 0
