"""Encoders against the tokenizers library on hostile texts, and what a worker keeps."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandloom.llm import tokens

BYTE, WORD = (tokens.tokenizer_path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def hostile(n, seed):
    rng = random.Random(seed)
    marks = ["'s", "'LL", "  ", "\n", "\t \n", "<|endoftext|>", "\x1c", "\x85", "　", "​", "é", "é", "ß", "İ", "5", "٣", "½", "漢字", "한", "ไทย", "👩‍👩‍👧", "!?", "--", "</w>", "\0", "a", "Zq", " "]
    for _ in range(n):
        yield "".join(rng.choice(marks) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(60)))


def test_ids_equal_the_library():
    assert tokens.PATTERN == public_tokenizers.PATTERN
    encoder, fast = Tokenizer.from_file(BYTE), tokens.PieceIds(BYTE)
    texts = [*hostile(3000, 1), " " * 300_000 + "x", "\n \n" * 50_000, "漢" * 300_000, "ab1" * 100_000, "", "<|endoftext|>" * 50]
    for text, got in zip(texts, fast.many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encoder.encode(text, add_special_tokens=False).ids


def test_lengths_equal_the_library():
    encoder, lengths = Tokenizer.from_file(WORD), tokens.WordLengths(WORD)
    texts = [*hostile(3000, 2), "漢" * 100_000, "x" * 400_000 + " y", "a b\n" * 100_000]
    want = [len(encoder.encode(x, add_special_tokens=False).ids) for x in texts]
    assert lengths.many([x.encode() for x in texts]) == want


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 1 << 18)
    lengths, rng = tokens.WordLengths(WORD), random.Random(3)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdefghij", k=rng.choice([6, 9, 5000]))) for _ in range(3000)).encode()
        lengths.many([text])
        assert lengths.held == sum(len(x) + tokens.ENTRY for x in lengths.kept) <= (1 << 18) + len(text)
        assert all(len(x) <= tokens.KEPT_WORD for x in lengths.kept)
