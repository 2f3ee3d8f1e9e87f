"""Byte-level BPE with memories that overflow all the time, against the tiktoken library."""

import random
import struct

import public_tokenizers
import tiktoken

from contactlake.llm import bpe
from tests.llm.conftest import prose


def test_small_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    monkeypatch.setattr(bpe, "GATHERED", 5)
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder, decoder = bpe.Encoder(bpe.serialise_model(tokens), public_tokenizers.PATTERN), bpe.Decoder(tokens)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )
    draw = random.Random(3)
    for turn in range(30):
        texts = [prose(draw.randint(0, 9), draw.randint(0, 30)) + draw.choice(["", "  x", "\n é😀", " 12,5."]) for _ in range(8)]
        texts += [None, "", " "]
        ids = encoder.encode(texts)
        assert [list(struct.unpack(f"<{len(i) // 4}I", i)) for i in ids] == [library.encode_ordinary(t or "") for t in texts]
        assert decoder.decode([*ids, None]) == [*[(t or "").encode() for t in texts], None], turn
