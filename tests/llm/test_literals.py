"""Literals of added tokens in texts."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from contactlake.llm import tokens


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.WordEncoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "B", "word", "é", "\u0301", ".", ",", " ", "\n", "\x85"]


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_op1_literals_of_added_tokens(both, text):
    words, whole = both
    assert np.frombuffer(words.encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_op1_literal_is_one_id(both):
    assert np.frombuffer(both[0].encode(["a <|endoftext|> b"])[0], "<u2").tolist() == [320, 49407, 321]
