"""The words of packing: marks at their ends, and one tokenizer for the tasks of a worker."""

import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pulseframe.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_marks_are_set_apart_at_the_ends_of_words():
    plain = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,!?;:*$%&#]+(?:[ \t-\r]|\Z))")
    pick = random.Random(3)
    for _ in range(5000):
        text = "".join(pick.choice("aZ9.,!#é-\x0b \n") for _ in range(pick.randint(0, 12))).encode()
        assert packing.END_MARKS.sub(rb" \g<0>", text) == plain.sub(b" ", text)


def test_the_tokenizer_is_read_once(monkeypatch):
    read = []

    class Counted:
        @staticmethod
        def from_file(path):
            read.append(path)
            return Tokenizer.from_file(path)

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    packing._tokenizer.cache_clear()
    text = "Some words, a1-b2! and <|endoftext|> more... 12,5"
    for _ in range(2):
        (packed,) = packing._Words(TOKENIZER).packed([text.encode()])
        assert np.frombuffer(packed, "<u4").tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert read == [TOKENIZER]
