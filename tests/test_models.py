"""WordPiece, Unigram and byte-pair models in Spark, id by id against the library that defines the files."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tokscope.operators.frequency import token_frequency
from tokscope.operators.subwords import best_path, entry_bitmap, merge_lowest
from tokscope.operators.tokenizer import SparkTokenizer, encode_documents, parse_spec, piece_tokens
from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_TOKENIZER, FIXTURE_UNIGRAM_TOKENIZER, FIXTURE_WORDPIECE_TOKENIZER

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "Hello, World! it's 42.", "naïve CAFÉ café ÀÉÎ", "tab\tnew\nline\r\n  two  spaces ", "unaffable word-pieces", "日本語 한국어 中文abc",
    "ΣΑΣ ΟΔΟΣ İstanbul Straße ﬁne ① ½", "x" * 120, "ạ́ ̣b q̣̇", "emoji 👍🏽 and ​ zero ﻿ width \x00\x07 ctrl�",
    "[UNK] [CLS] text <unk> [SEP]", " nbsp　wide", "don't $5+3=8 ^~` a_b", "▁mark ▁▁ two", "the the the", "ththth erere",
]


def _conf(path):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _with(path, **changes):
    return {**_conf(path), **changes}


def _variants():
    yield "wordpiece", _conf(FIXTURE_WORDPIECE_TOKENIZER)
    cased = _conf(FIXTURE_WORDPIECE_TOKENIZER)
    cased["normalizer"] = {"type": "BertNormalizer", "clean_text": False, "handle_chinese_chars": False, "strip_accents": False, "lowercase": False}
    cased["model"]["max_input_chars_per_word"] = 9
    yield "wordpiece, cased, short words only", cased
    yield "wordpiece on runs of word characters", _with(FIXTURE_WORDPIECE_TOKENIZER, pre_tokenizer={"type": "Whitespace"}, normalizer={"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]})
    yield "unigram", _conf(FIXTURE_UNIGRAM_TOKENIZER)
    yield "unigram, first word only marked", _with(FIXTURE_UNIGRAM_TOKENIZER, pre_tokenizer={"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first", "split": True}, normalizer={"type": "NFKC"})
    yield "unigram, whole texts", _with(FIXTURE_UNIGRAM_TOKENIZER, pre_tokenizer={"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never", "split": False})
    yield "word ends", _conf(public_tokenizers.path("word_bpe_49k.json"))
    yield "normalizers", _with(FIXTURE_TOKENIZER, normalizer={"type": "Sequence", "normalizers": [{"type": "NFKD"}, {"type": "Strip", "strip_left": True, "strip_right": True}, {"type": "Replace", "pattern": {"String": "th"}, "content": "$1\\"}, {"type": "Prepend", "prepend": "> "}, {"type": "Lowercase"}]})
    yield "white space gaps", _with(FIXTURE_TOKENIZER, pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation", "behavior": "Isolated"}, {"type": "Digits", "individual_digits": True}]})
    yield "space before", _with(FIXTURE_BYTE_LEVEL_TOKENIZER, pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})
    mixed = _conf(FIXTURE_TOKENIZER)
    random.Random(3).shuffle(mixed["model"]["merges"])
    yield "merges in any order", mixed


VARIANTS = dict(_variants())


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()
    return [*ODD, *(r.text for r in docs)]


@pytest.mark.parametrize("name", VARIANTS)
def test_ids_equal_the_library(spark, tmp_path, texts, name):
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(VARIANTS[name]), encoding="utf-8")
    tok = SparkTokenizer(spark, str(path))
    assert tok.spec.native, tok.spec.reason
    assert tok.spec.ordered == (name != "merges in any order")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(str(path))
    for special in (False, True):
        got = {r.doc_id: r.ids for r in encode_documents(df, tok.spec, tok.merges, tok.vocab, add_special_tokens=special).collect()}
        for i, e in enumerate(library.encode_batch(texts, add_special_tokens=special)):
            assert got[i] == e.ids, texts[i][:80]
        flat = [x for ids in got.values() for x in ids]
        counts = {r.token_id: r["count"] for r in token_frequency(df, tok, add_special_tokens=special).collect()}
        assert counts == {x: flat.count(x) for x in set(flat)}


@pytest.mark.parametrize("path", [FIXTURE_TOKENIZER, FIXTURE_UNIGRAM_TOKENIZER])
def test_long_piece(spark, path):
    """Text without a space is one piece: equal to the library, and a megabyte of it is cut in bounded memory."""
    rng = random.Random(5)
    text = "".join(rng.choice(["th", "er", "an", "on", "st", "é", "qu", "z"]) for _ in range(520_000))[:1_000_000]
    tok = SparkTokenizer(spark, path)
    got = {r.token_id: r["count"] for r in token_frequency(spark.createDataFrame([(text[:5000],)], "text string"), tok).collect()}
    ids = Tokenizer.from_file(path).encode(text[:5000], add_special_tokens=False).ids
    assert got == {x: ids.count(x) for x in set(ids)}
    pieces = spark.createDataFrame([(text, False)], "piece string, is_added boolean")
    tokens = piece_tokens(pieces, tok.spec, tok.merges, tok.vocab)
    assert [tuple(r) for r in tokens.selectExpr("array_join(tokens, '') = piece", "size(tokens) > 300000").collect()] == [(True, True)]


def test_best_path_against_all_paths():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 7)
        entries = {(a, b): rng.randint(-8, 0) / 4 for a in range(n) for b in range(a + 1, n + 1) if rng.random() < 0.5}
        rows = list(entries.items())
        path = best_path(n, np.array([a for (a, _), _ in rows], int), np.array([b for (_, b), _ in rows], int), np.array([s for _, s in rows], float), -20.0)

        def value(e):
            if e == 0:
                return 0.0
            steps = [value(s) + entries[s, e] for s in range(e) if (s, e) in entries]
            return max(steps + ([value(e - 1) - 20.0] if (e - 1, e) not in entries else []))

        assert sum(entries[s, e] if known else -20.0 for s, e, known in path) == value(n)
        assert [s for s, _, _ in path] == [0, *[e for _, e, _ in path][:-1]] and path[-1][1] == n


def test_merge_lowest_is_one_merge_at_a_time():
    rng = random.Random(2)
    for _ in range(300):
        ranks = {}
        for r in range(12):
            a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 2))) for _ in range(2))
            ranks.setdefault((a, b), r)
        symbols = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        plain = list(symbols)
        while hits := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]:
            _, i = min(hits)
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert merge_lowest(symbols, lambda a, b: ranks.get((a, b))) == plain


def test_specs():
    assert parse_spec(json.dumps(_conf(FIXTURE_WORDPIECE_TOKENIZER))).before == (1,)
    assert entry_bitmap([]) is None and entry_bitmap(map(str, range(1 << 20))) is None
    post = {"type": "BertProcessing", "sep": ["[SEP]", 2], "cls": ["[CLS]", 1]}
    spec = parse_spec(json.dumps(_with(FIXTURE_WORDPIECE_TOKENIZER, post_processor=post)))
    assert (spec.before, spec.after) == ((1,), (2,))
