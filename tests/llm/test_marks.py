"""Words with marks behind them are put together from what is known of their parts."""

import numpy as np
import pytest

tokens = pytest.importorskip("contactlake.llm.tokens")
public_tokenizers = pytest.importorskip("public_tokenizers")


def _encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return tokens.WordEncoder(file.read())


def test_marks_behind_letters_are_not_encoded_with_their_word(monkeypatch):
    encoder, alone = _encoder(), []
    whole = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words: (alone.extend(words), whole(words))[1])
    text = "heres%%% Thatis$$$ été.!! dogs' a<|endoftext|> b<|EndOfText|> x_! 12;"
    got = np.frombuffer(encoder.encode([text])[0], f"<u{encoder.width}").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert not any(w[:1].isalpha() and w.rstrip(tokens.MARKS).isalpha() for w in alone)


def test_words_of_the_older_generation_are_not_encoded_again(monkeypatch):
    encoder = _encoder()
    first = encoder.encode(["zweig ast"])
    encoder.known, encoder.older = {}, encoder.known
    monkeypatch.setattr(encoder, "_encode_letters", lambda words: (_ for _ in ()).throw(AssertionError(words)) if words else iter(()))
    encoder._encode = lambda words: [b"" for _ in words]
    assert encoder.encode(["Zweig ast"])[0] == first[0]
