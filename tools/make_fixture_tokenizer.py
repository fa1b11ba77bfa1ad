"""Build the fixture ``tokenizer.json`` used by tests and registered queries.

The vocabulary is trained once, offline, with the public ``tokenizers``
BPE trainer over the sf0.001 ``documents`` table. It stands in for a hub
vocabulary (not reachable here). Training is a fixture step, not an
operator of the engine.

    python tools/make_fixture_tokenizer.py /root/testdata/sf0.001 tokscope/resources/tokenizer.json
    python tools/make_fixture_tokenizer.py /root/testdata/sf0.001 tokscope/resources/tokenizer_byte_level.json byte_level
"""

from __future__ import annotations

import sys

import pyarrow.parquet as pq
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers, trainers

from tokscope.functions.text import PRETOKEN_PATTERN

VOCAB_SIZE = 500


def main(sf_dir: str, out_path: str) -> None:
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Split(Regex(PRETOKEN_PATTERN), behavior="isolated")
    # Printable ASCII, tab/newline/carriage return and Latin-1 letters: the
    # alphabet is fixed so a character missing from sf0.001 still has an id.
    alphabet = [chr(c) for c in range(0x20, 0x7F)] + ["\t", "\n", "\r"] + [chr(c) for c in range(0xC0, 0x100)]
    trainer = trainers.BpeTrainer(
        vocab_size=VOCAB_SIZE,
        special_tokens=["[UNK]"],
        initial_alphabet=alphabet,
        show_progress=False,
    )
    tok.train_from_iterator(texts, trainer=trainer)
    tok.save(out_path)


def main_byte_level(sf_dir: str, out_path: str) -> None:
    """A byte-level BPE fixture: GPT-2 style alphabet and pre-token pattern."""
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    tok.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=VOCAB_SIZE, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False
    )
    tok.train_from_iterator(texts, trainer=trainer)
    tok.save(out_path)


if __name__ == "__main__":
    if len(sys.argv) > 3 and sys.argv[3] == "byte_level":
        main_byte_level(sys.argv[1], sys.argv[2])
    else:
        main(sys.argv[1], sys.argv[2])
