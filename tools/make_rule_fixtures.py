"""Derive the WordPiece and Unigram fixtures from the byte-pair fixture by rule; nothing is trained.

Every token of ``tokenizer.json`` becomes, lower-cased and without accents, a
WordPiece entry and its continuing form; for Unigram, spaces become the
word mark and the score falls with the token's number, in 64ths so that sums
are exact.

    python tools/make_rule_fixtures.py tokscope/resources/tokenizer.json tokscope/resources
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokscope.operators.normalize import strip_marks  # noqa: E402

MARK = "▁"


def _added(token: str, i: int) -> dict:
    return {"id": i, "content": token, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def wordpiece(tokens: list[str]) -> dict:
    words = dict.fromkeys(w for t in tokens if (w := strip_marks(t.strip())))
    entries = ["[UNK]", "[CLS]", "[SEP]", *words, *(f"##{w}" for w in words if w.isalnum())]
    special = {t: {"id": t, "ids": [entries.index(t)], "tokens": [t]} for t in ("[CLS]", "[SEP]")}
    template = lambda *parts: [{"Sequence": {"id": p, "type_id": 0}} if len(p) == 1 else {"SpecialToken": {"id": p, "type_id": 0}} for p in parts]
    return {
        "version": "1.0",
        "added_tokens": [_added(t, i) for i, t in enumerate(entries[:3])],
        "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True},
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"type": "TemplateProcessing", "single": template("[CLS]", "A", "[SEP]"), "pair": template("[CLS]", "A", "[SEP]", "B", "[SEP]"), "special_tokens": special},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": {t: i for i, t in enumerate(entries)}},
    }


def unigram(tokens: list[str]) -> dict:
    entries = dict.fromkeys(t.replace(" ", MARK) for t in tokens if t.strip())
    vocab = [["<unk>", 0.0], [MARK, -3.0], *([t, -(4 + i / 64)] for i, t in enumerate(x for x in entries if x != MARK))]
    return {
        "version": "1.0",
        "added_tokens": [_added("<unk>", 0)],
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "[\\t\\n\\r]"}, "content": " "}]},
        "pre_tokenizer": {"type": "Metaspace", "replacement": MARK, "prepend_scheme": "always", "split": True},
        "model": {"type": "Unigram", "unk_id": 0, "vocab": vocab, "byte_fallback": False},
    }


def main(source: str, folder: str) -> None:
    with open(source, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    tokens = [t for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t != "[UNK]"]
    for name, conf in (("tokenizer_wordpiece.json", wordpiece(tokens)), ("tokenizer_unigram.json", unigram(tokens))):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump(conf, f, ensure_ascii=False, indent=1)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
