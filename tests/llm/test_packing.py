import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from tokscope.llm.packing import best_two_fit, cut, encoder, pack_documents
from tokscope.llm.queries import op8_best_fit_packing


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, ids, capacity):
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_registered_query_round_trip(spark, docs):
    ids = dict(zip(docs, reference_ids(list(docs.values())), strict=True))
    n = check(op8_best_fit_packing(spark, SF).collect(), ids, 1024)
    assert n <= 1.05 * sum(map(len, ids.values())) / 1024 + 2


def test_encoder_equals_tokenizers():
    texts = ["", " ", "<|endoftext|> a", "naïve 漢字 \u200b\u00a0x", "a" * 5000, "  \n\n\t 12345,67!!", "😀👍🏽 it's we'll", "\r\n\r\n", "Ⅷ ½ ０１"]
    rng = random.Random(5)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x4F00), 10, 32])) for _ in range(300)) for _ in range(200)]
    assert [[*encoder().encode_ordinary(t), 2] for t in texts] == [x.tolist() for x in reference_ids(texts)]


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    for _ in range(30):
        counts = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))}
        plan = best_two_fit(counts, 100)
        used = collections.Counter()
        for lengths, n in plan:
            assert n > 0 and sum(lengths) <= 100
            for x in lengths:
                used[x] += n
        assert used == collections.Counter(counts)


def test_two_replace_the_smallest():
    # Greedy takes 6 + 3 and leaves a gap; 2 + 2 in place of the 3 fill it.
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_cut():
    assert cut(1024, 1024) == [(0, 1024)] and cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_odd_rows(odd, empty):
    rows = pack_documents(odd, with_ids=True).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert [r.ids for r in rows if r.doc_id in (1, 2, 6)] == [[2]] * 3
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert pack_documents(empty).count() == 0


def test_added_tokens_are_single_ids(spark):
    """As `tokenizers` at its defaults, apart from ``add_special_tokens=False``."""
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n", "<|endoftext", "plain", "<|endoftext|> 漢字 it's"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275, 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in pack_documents(df, with_ids=True).collect()} == dict(enumerate(want))
