"""Byte-level BPE of whole columns: few calls of the library, a bounded memory, equal ids."""

import struct

import pytest

bpe = pytest.importorskip("contactlake.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


class _Counted:
    def __init__(self, pieces):
        self.pieces, self.strings = pieces, 0

    def encode(self, strings, **how):
        self.strings += len(strings)
        return self.pieces.encode(strings, **how)

    def __getattr__(self, name):
        return getattr(self.pieces, name)


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture
def encoder(tokens):
    return bpe.Encoder(bpe.serialise_model(tokens), public_tokenizers.PATTERN)


def _equal(encoder, tokens, texts):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )
    ids = [list(struct.unpack(f"<{len(i) // 4}I", i)) for i in encoder.encode(texts)]
    return ids == [library.encode_ordinary(t or "") for t in texts]


def test_new_words_are_encoded_many_in_a_call(encoder, tokens):
    encoder.pieces = _Counted(encoder.pieces)
    words = [a + b + c + m for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for m in ("", "...")]
    assert _equal(encoder, tokens, [" ".join(words), "\n".join(words)])
    assert 0 < encoder.pieces.strings < len(words) // 2


@pytest.mark.parametrize("text", [
    "", " ", "\n", " a", "a ", "  a", "a\n\nb c", "\na b", "a\tb c", "it's a\n dog's ' 's", "ab,, !! ab,,", "x  \n y",
    "␃ a␃b", "\xff \xfe", "été 一 12", "a\x00 \x00",
])
def test_every_kind_of_cut(encoder, tokens, text):
    assert _equal(encoder, tokens, [text, None, f"{text} {text}", text + text])


def test_long_strings_are_forgotten(monkeypatch, encoder, tokens):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 5000)
    for i in range(20):
        assert _equal(encoder, tokens, [chr(0x4E00 + i) * 200 + " ab", "ab cd"])
        assert encoder.known.strings.nbytes + encoder.known.ids.nbytes < 10_000


def test_words_wanted_last_are_kept(monkeypatch, encoder, tokens):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for i in range(30):
        assert _equal(encoder, tokens, [f"often seen w{i}", f"seen often {i}x"])
        assert len(encoder.known.strings) < 20
        assert {"often", "seen"} <= set(encoder.known.strings.to_pylist())


def test_a_vocabulary_without_a_byte_is_refused():
    encoder = bpe.Encoder(bpe.serialise_model([b"a", b" ", b"aa"]), public_tokenizers.PATTERN)
    assert encoder.encode(["aaa a"]) == [struct.pack("<4I", 2, 0, 1, 0)]
    with pytest.raises(ValueError, match="no piece"):
        encoder.encode(["ab"])
    with pytest.raises(ValueError, match="no piece"):
        encoder.encode(["a ba"])
