"""Token ids over arrays of texts: a piece is looked up once for all its places,
and the ids stay those of the plain tokenizer wherever texts are cut."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orchard.llm import tokens
from orchard.llm.queries import END_ID, TOKENIZER


class Counted(dict):
    asked = 0

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)


def test_a_piece_is_looked_up_once_for_many_texts():
    encoder = tokens.CachedEncoder(public_tokenizers.path(TOKENIZER), END_ID)
    encoder.pieces = Counted(encoder.pieces)
    words = ["Apples", "and", "pears", "véry", "it's", "7", "..."]
    rng = random.Random(2)
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(300)]
    Counted.asked = 0
    encoder.encode_all(texts)
    assert Counted.asked < 30                   # 9 pieces, of which there are over 15,000


@pytest.mark.parametrize("size", [6, 200, 1 << 22])
def test_ids_of_many_texts_equal_the_plain_ones_wherever_they_are_cut(monkeypatch, size):
    monkeypatch.setattr(tokens, "AT_ONCE", size)
    path = public_tokenizers.path(TOKENIZER)
    encoder, plain = tokens.CachedEncoder(path, END_ID), Tokenizer.from_file(path)
    rng = random.Random(7)
    some = ["'", "''", *"stmdrevlLSTRE019.,!\"", " ", "\n", "'s", "'LL", "é", "É", "×", "÷", "ſ", "…", "’", "Ÿ"]
    odd = [*some, "İ", "中", "\x00", "\x01", "<|endoftext|>"]
    for _ in range(20):
        texts = [None, "", *("".join(rng.choices(some if rng.random() < 0.8 else odd, k=rng.randrange(40)))
                             for _ in range(60))]
        want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, END_ID], "<i4").tobytes() for t in texts]
        assert encoder.encode_all(texts) == want
    assert encoder.encode_all([]) == []
