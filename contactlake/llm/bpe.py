"""Byte-level BPE by a sentencepiece model written straight from the vocabulary.

The vocabulary file gives byte strings and their ranks. Every byte is mapped to
one printable character, so each byte string becomes a piece; the piece's score
is its negative rank and its place is its id. With identity normalisation the
sentencepiece library then merges exactly as a rank-ordered merge of bytes does.
Texts are cut into pre-tokens by the public pattern. Pre-tokens are encoded with
a character between them that no piece holds, so that none merges with another;
decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable
from itertools import chain
from string import ascii_letters

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: encoded strings that a worker keeps when it knows twice as many
REMEMBERED = 250_000
#: bytes of strings and ids beyond which a worker forgets them all
REMEMBERED_BYTES = 256 << 20
#: pre-tokens that are encoded in one call
TOGETHER = 50
#: runs of ids, or of bytes, that are put together at once
GATHERED = 1 << 18
#: ends a pre-token; UTF-8 has no such byte, and no piece has its character
END, SHOWN_END = b"\xff", "\u2403"
BYTES = pa.large_binary()
#: an id is an unsigned little-endian integer of so many bytes
ID_BYTES = 4
#: a run of these behind letters, with nothing after it, is a pre-token of its own
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
UNKNOWN_PIECE = ""


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of ``base64 rank`` lines, by rank."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranked[i] for i in range(len(ranked))]


def byte_characters() -> dict[int, str]:
    """One printable character per byte: itself where Latin-1 prints it, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


SPACE = byte_characters()[0x20]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a length-delimited string, a varint or a float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model with the tokens as pieces; a piece's id is its rank."""
    shown = byte_characters()
    normal, unknown, kind_bpe = 1, 2, 2
    pieces = [("".join(map(shown.__getitem__, t)), -float(i), normal) for i, t in enumerate(tokens)]
    pieces.append((UNKNOWN_PIECE, 0.0, unknown))
    body = b"".join(
        _field(1, _field(1, piece.encode()) + _field(2, score) + _field(3, kind)) for piece, score, kind in pieces
    )
    trainer = _field(3, kind_bpe) + _field(40, len(tokens)) + _field(45, UNKNOWN_PIECE.encode())
    # identity: no dummy prefix, no joined white space, no escaped white space
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, identity)


def _strings(texts: Iterable[str]) -> pa.Array:
    """Texts as an Arrow array; what has no UTF-8 stays as it is."""
    return pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())


def _gather(content: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted runs of an array, one behind the other; runs begin and are as long as told."""
    parts = []
    for at in range(0, len(wanted), GATHERED):
        runs = wanted[at : at + GATHERED]
        length = sizes[runs]
        ends = np.cumsum(length)
        # an item's place in its run, counted on from the run's start
        places = np.repeat(starts[runs] - ends + length, length)
        places += np.arange(len(places))
        parts.append(content[places])
    return np.concatenate(parts) if parts else content[:0]


class _Memory:
    """Known strings, each with a run of ids; those that were wanted last are kept."""

    def __init__(self):
        self.strings = _strings([])
        self.ids = np.zeros(0, "<u4")
        self.starts = self.sizes = self.wanted = np.zeros(0, np.int64)
        self.turn = 0

    def age(self) -> None:
        """Forget all of too many bytes; of more than twice REMEMBERED strings keep the REMEMBERED that were wanted last."""
        if self.strings.nbytes + self.ids.nbytes > REMEMBERED_BYTES:
            self.__init__()
        self.turn += 1
        if len(self.strings) > 2 * REMEMBERED:
            kept = np.sort(np.argpartition(self.wanted, -REMEMBERED)[-REMEMBERED:])
            self.ids = _gather(self.ids, self.starts, self.sizes, kept)
            self.strings, self.sizes, self.wanted = self.strings.take(pa.array(kept)), self.sizes[kept], self.wanted[kept]
            self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, strings: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, ...]]) -> np.ndarray:
        """The place of each string; ``learn`` gives ids for the new ones, and where theirs start and how many they are."""
        found = pc.index_in(strings, value_set=self.strings)
        unknown = found.is_null()
        places = found.fill_null(0).to_numpy().astype(np.int64)
        new = strings.filter(unknown).dictionary_encode()
        if len(new):
            places[unknown.to_numpy(zero_copy_only=False)] = new.indices.to_numpy() + len(self.strings)
            ids, starts, sizes = learn(new.dictionary)
            self.strings = pa.concat_arrays([self.strings, new.dictionary])
            self.starts = np.concatenate([self.starts, starts + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.wanted = np.concatenate([self.wanted, np.zeros(len(sizes), np.int64)])
            self.ids = np.concatenate([self.ids, ids])
        self.wanted[places] = self.turn
        return places


class Encoder:
    """Texts to id bytes; remembers strings that come again.

    Texts are cut, looked up and put together as whole Arrow columns. A string
    counts with a space before it; one that begins with a line break, and the
    rest of one that begins with a space, count as they stand.
    """

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.adjacent = regex.compile(r"\s\s")
        self.between = regex.compile(r"(?<=\S) (?=\S)")
        shown = byte_characters()
        self.lacking = [b for b in range(END[0]) if self.pieces.piece_to_id(shown[b]) == self.pieces.unk_id()]
        shown[END[0]] = SHOWN_END
        self.shown = np.array([ord(shown[b]) for b in range(256)], "<u4")
        self.known = _Memory()

    def _pretokens(self, span: str) -> list[str]:
        """The pre-tokens of a part that a space or, as its first character, a line break sets off."""
        if span.isalpha():  # the letters of the pattern
            return [" " + span]
        head = span.rstrip(MARKS)
        if len(head) < len(span) and head.isalpha():
            return [" " + head, span[len(head) :]]
        return self.pattern.findall(span if span[:1] == "\n" else " " + span)

    def _merge(self, ended: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens that each have END behind them, and how many ids the first 0, 1, 2 and so on have.

        No piece holds END's character, so pre-tokens in one call do not merge with each other.
        """
        content = np.frombuffer(ended, np.uint8)
        if self.lacking and np.isin(content, self.lacking).any():
            raise ValueError("a text has a byte that is no piece of the vocabulary")
        characters = self.shown[content]
        cuts = np.flatnonzero(characters == ord(SHOWN_END))[TOGETHER - 1 :: TOGETHER] + 1
        calls = [part.tobytes().decode("utf-32-le") for part in np.split(characters, cuts) if len(part)]
        merged = self.pieces.encode(calls, num_threads=1) if calls else []
        ids = np.fromiter(chain.from_iterable(merged), "<u4", sum(map(len, merged)))
        end = ids == self.pieces.unk_id()
        ends = np.flatnonzero(end)
        return ids[~end], np.concatenate([[0], ends - np.arange(len(ends))])

    def _learn(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of strings, and each one's first place in them and number of them."""
        # words of ASCII letters, with or without a run of marks behind, are told all at once
        heads, tails = pc.ascii_rtrim(strings, MARKS), pc.ascii_ltrim(strings, ascii_letters)
        word = pc.ascii_is_alpha(heads)
        heads, tails = heads.filter(word).cast(BYTES), tails.filter(word).cast(BYTES)
        marked = pc.greater(pc.binary_length(tails), 0)
        space, end, nothing = (pa.scalar(b, BYTES) for b in (b" ", END, b""))
        words = pc.binary_join_element_wise(space, heads, end, tails, pc.if_else(marked, end, nothing), nothing)
        others = [
            self.pattern.findall(s[1:]) if s[:1] == " " else self._pretokens(s)
            for s in (b.decode("utf-8", "surrogatepass") for b in strings.filter(pc.invert(word)).cast(BYTES).to_pylist())
        ]
        tokens = [t.encode("utf-8", "surrogatepass") for t in chain.from_iterable(others)]
        ids, before = self._merge(b"".join([*words.to_pylist(), *(t + END for t in tokens)]))
        found = np.fromiter(map(len, others), np.int64, len(others))
        counts = np.concatenate([1 + marked.to_numpy(zero_copy_only=False), found])
        last = np.cumsum(counts)
        starts, ends = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        is_word = word.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(is_word), np.flatnonzero(~is_word)])
        starts[order], ends[order] = before[last - counts], before[last]
        return ids, starts, ends - starts

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        self.known.age()
        texts = [t or "" for t in texts]
        # Where no two white space characters meet, every pre-token with a space in it
        # starts with that space and a line break stands alone, so a text may be cut
        # before each of them and equal parts have equal ids. Any other text may be
        # cut before a space that no white space adjoins.
        simple = np.array([not self.adjacent.search(t) for t in texts], bool)
        cut = pc.split_pattern(pc.replace_substring(_strings(t for t, s in zip(texts, simple) if s), "\n", " \n"), " ")
        other = [self.between.split(t) for t, s in zip(texts, simple) if not s]
        parts = pa.concat_arrays([cut.flatten(), _strings(chain.from_iterable(other))])
        counts = np.concatenate([pc.list_value_length(cut).to_numpy(), np.fromiter(map(len, other), np.int64, len(other))])
        last = np.cumsum(counts)
        first = np.zeros(len(parts), bool)
        first[last - counts] = True
        # the first part has no space before it
        heads = pc.binary_join_element_wise(*_strings([" "]), parts.filter(pa.array(first)), *_strings([""]))
        places = np.empty(len(parts), np.int64)
        places[np.concatenate([np.flatnonzero(~first), np.flatnonzero(first)])] = self.known.places(
            pa.concat_arrays([parts.filter(pa.array(~first)), heads]), self._learn
        )
        sizes = self.known.sizes[places]
        ids = _gather(self.known.ids, self.known.starts, self.known.sizes, places).tobytes()
        ends = ID_BYTES * np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], last])]
        out = [b""] * len(texts)
        for i, start, stop in zip([*np.flatnonzero(simple), *np.flatnonzero(~simple)], ends[:-1], ends[1:]):
            out[i] = ids[start:stop]
        return out


class Decoder:
    """Ids to bytes: one gather over the joined bytes of all tokens."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, texts: Iterable[bytes | None]) -> list[bytes | None]:
        """The bytes of each text's ids; null stays null."""
        out: list[bytes | None] = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            ids = np.frombuffer(text, "<u4")
            out.append(_gather(self.bytes, self.starts, self.sizes, ids).tobytes())
        return out


_loaded: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


class ByteBpe:
    """A byte-level BPE vocabulary as Spark columns.

    The vocabulary file is read on the driver; its model of about a megabyte is
    what the tasks get.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        self.pattern = pattern
        self.model = serialise_model(tokens)
        self.name = hashlib.sha256(self.model + pattern.encode()).hexdigest()
        self._model = spark.sparkContext.broadcast(self.model)
        self._tokens = spark.sparkContext.broadcast(tokens)

    def encode(self, text: Column) -> Column:
        """Ids as bytes, ``ID_BYTES`` each; a null or empty text has none."""
        model, name, pattern = self._model, self.name, self.pattern

        @F.pandas_udf("binary")
        def ids(texts: pd.Series) -> pd.Series:
            if name not in _loaded:
                _loaded[name] = Encoder(model.value, pattern)
            found = pd.Series(_loaded[name].encode(texts))
            pa.default_memory_pool().release_unused()  # other stages run in the same worker
            return found

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for; null ids give null."""
        tokens, name = self._tokens, self.name

        @F.pandas_udf("binary")
        def content(ids: pd.Series) -> pd.Series:
            if name not in _decoders:
                _decoders[name] = Decoder(tokens.value)
            return pd.Series(_decoders[name].decode(ids), dtype=object)

        return content(ids)


def round_trip(docs: DataFrame, codec: ByteBpe, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``(key, n_tokens, ids, decoded)``: a text's ids, and the bytes they decode to.

    Null texts count as empty, which have no ids; repeated rows and null keys
    stay; an empty table gives an empty result.
    """
    encoded = docs.select(F.col(key).alias(key), codec.encode(F.col(text)).alias("ids"))
    return encoded.select(
        key, (F.octet_length("ids") / ID_BYTES).cast("bigint").alias("n_tokens"), "ids",
        codec.decode(F.col("ids")).alias("decoded"),
    )
