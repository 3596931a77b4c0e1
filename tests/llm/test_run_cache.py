"""op5's encoder: a word is looked up in one place whatever stands after it, and ids stay the library's."""

import random

import numpy as np
from tokenizers import Tokenizer

from palimpsest.llm import packing, registry


def test_words_of_runs_share_the_cache(monkeypatch):
    monkeypatch.setattr(packing, "_encoders", {})
    encode = packing.chunk_encoder(registry.vocabulary("word_bpe_49k.json"))
    encode[b"reanouening,"]
    assert b"reanouening" in encode  # the run without its comma is known, too


def test_ids_of_runs_are_the_librarys():
    path = registry.vocabulary("word_bpe_49k.json")
    encode, library, rnd = packing.chunk_encoder(path).__getitem__, Tokenizer.from_file(path), random.Random(3)
    parts = [*"abzABZ019'.,-<|>_~! \t\n", "'s", "'re", "'ll", "é", "É", "ß", "Ÿ", "ſ", "×", "İ", "Σ", "ж", "\x00", "\x7f", "\x1c", "\xa0", "\x85", "<|endoftext|>", "’", "中"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        got = np.frombuffer(b"".join(packing.block_ids(text.encode(), encode, b"")), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text
