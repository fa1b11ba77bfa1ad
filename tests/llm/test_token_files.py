import glob
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from tokscope.llm.packing import tokenizer_path
from tokscope.llm.queries import op11_token_files
from tokscope.llm.token_files import TextEncoder, TokenLayout, read_index, read_range, read_tokens, splits_at_space, token_digests, write_tokens
from tokscope.session import scratch_path

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(NAME))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_registered_query(spark, docs, library):
    start, want = 0, {}
    for doc in sorted(docs):
        ids = ids_of(library, docs[doc])
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op11_token_files(spark, SF).collect()}
    assert got == want


def test_words_encode_like_whole_texts(docs, library):
    encoder = TextEncoder(NAME)
    assert encoder.by_word
    odd = ["", " ", "á b́", "x ́y", "ΣΑΣ ΟΔΟΣ", "İstanbul Straße ﬁn", "it's they'll I'VE 's", "12 34a５", "tab\tand\r\nend\n", "\x1c!\x1c ! \x85  !　x", "<|endoftext|> a<|startoftext|>b", "한국어 각 각", "ẹ̇ ̣̇", "a" * 3000, "\x00 \x0b\x0c.", "👩‍👩‍👧 👍🏽"]
    texts = odd + list(filter(None, docs.values()))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    small = TextEncoder(NAME)
    small.has_closes = False
    assert [x.tolist() for t in texts for x in small.encode([t])] == want
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not splits_at_space(json.load(f))
    other = TextEncoder("byte_bpe_50k.json")
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert [x.tolist() for x in other.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_capitals_and_marks_share_a_word(library, monkeypatch):
    encoder, sent, ids = TextEncoder(NAME), [], TextEncoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda tokenizer, texts: sent.extend(texts) or ids(tokenizer, texts))
    texts = ["that*** That!! THAT,", None, "Été*** été,", "", "that<|>\nthat"]
    flat, ends = encoder.encode_flat(pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(flat, ends)[:-1]] == want
    assert sorted(w for t in sent for w in t.split()) == sorted(["that", "été", "***", "!!", ",", "<|>"])  # each once


def test_odd_words_encode_like_whole_texts(library):
    words = ["a<|endoftext|>", "a<|endoftext|>,", "<|ENDOFTEXT|>", "it's", "dogs'", "a'S", "'Re,", "A.B", "a1!", "(a)", "***", "a_b_", "É-", "Ḥ̱!", "İ.", "ΟΔΟΣ.", "a\x0bB.", "a\x0c!", "x\u00a0Y!", "K\u212a!", "b́!", "B!\u0301"]
    texts = words + [a + b for a in words for b in words] + [f"{a} {b}\t{a}" for a in words for b in words]
    assert [x.tolist() for x in TextEncoder(NAME).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_forgotten(docs, library, monkeypatch):
    monkeypatch.setattr("tokscope.llm.token_files.MEMO_WORDS", 50)
    encoder = TextEncoder(NAME)
    texts = list(filter(None, docs.values()))[:60]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < len(encoder.memo) + len(encoder.old) < len({w for t in texts for w in t.split()})


@pytest.mark.parametrize(("encoding", "name"), [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_file_layout(spark, library, encoding, name):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('some words about ', id, ' ', repeat(sha2(string(id), 256), 1 + cast(id % 4 as int))) as text").repartition(3)
    path = scratch_path(spark, "layout")
    write_tokens(docs, path, layout=TokenLayout(encoding, row_group_bytes=32 << 10, page_rows=100))
    groups, last = 0, -1
    for file in sorted(glob.glob(path.removeprefix("file:") + "/ids/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert name in columns["ids.list.element"].encodings
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            stats = columns["doc_id"].statistics
            assert stats.min > last  # ascending over row groups and files
            last = stats.max
            groups += 1
    assert last == 3999 and groups > 3
    tokens = read_tokens(spark, path)
    some = tokens.filter(F.col("doc_id").between(1500, 1502))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1500)" in plan
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {d: ids_of(library, texts[d]) for d in (1500, 1501, 1502)}
    index = read_index(spark, path)
    schema = index._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in schema and index.agg(F.sum("n_tokens")).first()[0] == sum(len(ids_of(library, t)) for t in texts.values())


def test_ranges(spark, library):
    rows = [(i, "word " * (i % 7) if i % 5 else None) for i in range(300)]
    path = scratch_path(spark, "ranges")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    whole = [t for _, text in rows for t in ids_of(library, text)]
    for first, last in ((0, 5), (17, 18), (100, 400), (0, len(whole)), (len(whole) - 1, len(whole) + 9), (50, 50), (len(whole), len(whole) + 3)):
        got = [t for r in sorted(read_range(spark, path, first, last).collect(), key=lambda r: r.start) for t in r.ids]
        assert got == whole[first:last]


def test_odd_rows(spark, odd, empty, library):
    path = scratch_path(spark, "odd")
    write_tokens(odd, path)
    got = sorted(token_digests(read_tokens(spark, path)).collect(), key=lambda r: r.start)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]  # the row without an id comes first
    ids = [ids_of(library, r.text) for r in rows]
    assert [r.n_tokens for r in got] == [len(i) for i in ids]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    path = scratch_path(spark, "empty")
    write_tokens(empty, path)
    assert read_tokens(spark, path).count() == 0 and token_digests(read_tokens(spark, path)).count() == 0
    assert read_range(spark, path, 0, 10).count() == 0
