"""The pieces of words that a packing worker looks up, and how it finds them."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import packing


def test_pieces_are_remembered_not_their_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), packing.WordEncoder(open(path).read())
    letters, signs = "abcdefghij", ["", ",", ".", "!", "?", ";", ":", ")", "...", "'s", "'ll", "7"]
    texts = [" ".join(f"z{a}{b}{s}" for a in letters for b in letters for s in signs)] * 2
    for _ in range(3):
        for text, ids in zip(texts, fast.encode(texts), strict=True):
            assert np.array_equal(ids, plain.encode(text, add_special_tokens=False).ids)
    # 100 words, 11 endings; 1,200 with each of them
    assert fast.known["zab"] and 100 < len(fast.known) < 120


def test_pieces_in_use_outlast_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    fast = packing.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json")).read())
    common = " ".join(f"wö{a}{b}" for a in "abcde" for b in "abcde")
    asked = []

    class Model:
        model = fast.tokenizer.model

        def tokenize(self, piece):
            asked.append(piece)
            return self.model.tokenize(piece)

    fast.model = Model()
    for i in range(30):
        rare = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{a}{b}" for a in "uvwxyz" for b in "uvwxyz")
        for _ in range(2):
            fast.encode([f"{common} {rare}"])
    # the common ones at most twice, each rare one twice, though the memory was full many times
    assert len(asked) <= 2 * 25 + 30 * 2 * 36 and len(fast.known) + len(fast.before) <= 300


def test_splits_are_the_tokenizer_s():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), packing.WordEncoder(open(path).read())
    rng = random.Random(3)
    every = [chr(c) for c in range(0x300)]
    texts = [" ".join(every), "".join(every), "x" + "x".join(every), "'s'S''s x''ll'l'le'red're're 'rx v'v've'd'm7't", "'", "''", "'r", "it's,'s .'s", *every]
    texts += ["".join(rng.choice("'smtdrevlLx7 .é\n") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(every) for _ in range(20)) for _ in range(500)]
    for text, ids in zip(texts, fast.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert fast.encode([]) == [] and [len(x) for x in fast.encode(["", " \n", ""])] == [0, 0, 0]


def test_portions():
    texts = ["", "ab", "c", "defghijk", "", "l", "mn"]
    found = list(packing.portions(texts, 4))
    assert found == [["", "ab", "c"], ["defghijk"], ["", "l", "mn"]] and list(packing.portions([])) == []
