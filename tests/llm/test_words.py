"""The words whose ids a packing worker remembers."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import packing


def test_words_that_come_once_are_not_remembered():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), packing.WordEncoder(open(path).read())
    texts = [" ".join(f"zz{i}q{j}, the" for j in range(50)) for i in range(64)]
    for _ in range(2):
        for text, ids in zip(texts, fast.encode(texts), strict=True):
            assert np.array_equal(ids, plain.encode(text, add_special_tokens=False).ids)
        texts = [t.replace("zz", "yy") for t in texts]
    # met in both calls: "the" and the parts of the others; none of the 6,400 whole words but where hashes meet
    assert fast.known["the"] and len(fast.known) < 700


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), packing.WordEncoder(open(path).read())
    for start in (0, 0, 60, 60, 0, 120):
        texts = ["", *(" ".join(f"wört{c}{i}." for i in range(start, start + 90)) for c in "ab")]
        for text, ids in zip(texts, fast.encode(texts), strict=True):
            assert np.array_equal(ids, plain.encode(text, add_special_tokens=False).ids)
        assert len(fast.known) <= 100
