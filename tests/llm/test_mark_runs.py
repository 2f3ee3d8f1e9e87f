"""A run of marks behind letters is told without the pattern."""

import pytest

bpe = pytest.importorskip("contactlake.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")


class _Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)


def test_a_run_of_marks_behind_letters_needs_no_pattern():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = bpe.Encoder(bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    plain = encoder.pattern
    encoder.pattern = _Counted(plain)
    for span in ("heres%%%", "été.!!", "dogs'", "a--"):
        assert encoder._pretokens(span) == plain.findall(" " + span)
    assert encoder.pattern.calls == 0
    for span in ("it's!", "a_", "12,", "!!", "'", "x1.", "\n", "\nab,,"):
        assert encoder._pretokens(span) == plain.findall(span if span[:1] == "\n" else " " + span)
