"""Token-id files: every document compressed by itself with one shared dictionary.

A store is a folder of three Parquet tables, written by Spark's committer, so a
lost task leaves nothing behind:

``dictionary``  the zstandard dictionary trained on serialised id arrays, its
                SHA-256, and the width of an id in bytes
``parts``       per part the number of ids before it
``blocks``      per row a run of consecutive documents: their ids and token
                counts, ids before them within the part, the offset of each
                document's frame, the frames, and the dictionary's hash

Parts follow ascending document ids, blocks follow within parts, documents
within blocks. A short document is read by its block's key range, its offset
and one small frame.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

END_ID = 2
#: the dictionary is trained on so many documents at most, found in the rows
#: whose key hashes to 0 modulo SAMPLE_SHARE, and on so many characters of each
SAMPLE_DOCS = 2_000
SAMPLE_SHARE = 16
SAMPLE_CHARS = 4_096
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: documents in a part; beyond MAX_PARTS parts they grow instead, so that the
#: table of parts, which is broadcast, has a bound
PART_ROWS = 16_384
MAX_PARTS = 100_000
BLOCK_BYTES = 1 << 20
#: words that a worker remembers in one of two generations
REMEMBERED = 250_000
#: words of letters that are encoded in one call
TOGETHER = 50
#: a run of these behind letters is a pre-token of its own
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"

_BLOCKS = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
    ("before", pa.int64()), ("tokens", pa.int64()), ("dictionary_sha256", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
    ("frames", pa.binary()),
])
_BLOCKS_DDL = (
    "part int, block int, first_doc bigint, last_doc bigint, before bigint, tokens bigint, dictionary_sha256 string, "
    "doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, frames binary"
)
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class WordEncoder:
    """Whole texts to serialised ids; words that come again are looked up.

    White space ends a word for this kind of tokenizer and is dropped, so a
    text's ids are those of the parts between spaces and line breaks. The
    literals of added tokens have no white space, so they are found within
    words, in their own case only. Words are remembered in two generations: when the younger is full it becomes the
    older one, and words still in use move on.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_str(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max([END_ID, *vocabulary.values()]) < 1 << 16 else 4
        described = json.loads(tokenizer)
        suffix = described["model"].get("end_of_word_suffix") or "\0"
        self.literals = [t["content"] for t in described.get("added_tokens") or []]
        # letters with marks behind them are only cut where no literal can stand in them
        cuttable = not any(x.rstrip(MARKS).isalpha() or not x.rstrip(MARKS) for x in self.literals)
        self.marks = MARKS if cuttable else ""
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [self._bytes(e.ids) for e in found]

    def _encode_letters(self, words: list[str]) -> Iterator[bytes]:
        """Words of letters only are one run of ids each, whose last one ends a word: many are encoded at once."""
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(stops) == len(some) and stops[-1] == ids.nbytes:
                content, cuts = ids.tobytes(), [0, *stops.tolist()]
                yield from (content[a:b] for a, b in zip(cuts, cuts[1:]))
            else:
                yield from self._encode(some)

    def _lowered(self, word: str) -> str:
        """The word in lower case, unless that makes it hold the literal of an added token."""
        low = word.lower()
        return word if any(x in low for x in self.literals) else low

    def _recalled(self, wanted: set[str]) -> set[str]:
        """Those of the words that are new; the others are in the younger generation afterwards."""
        missing = wanted.difference(self.known)
        again = missing.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        return missing - again

    def _learn(self, wanted: set[str]) -> None:
        new = self._recalled(wanted)
        letters = [w for w in new if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        self.known.update(zip(letters, self._encode_letters(letters)))
        others = list(new.difference(letters))
        self.known.update(zip(others, self._encode(others)))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known = self.known
        cut = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = self._recalled(set().union(*cut))
        # marks behind letters are looked up by themselves, and a capital is its small letter
        whole, plain, tails, marks = [], {}, {}, self.marks
        for word in new:
            part = word
            if not word.isalpha():
                head = word.rstrip(marks)
                if len(head) < len(word) and head.isalpha() and (head.isascii() or head.lower().isalpha()):
                    part, tails[word] = head, word[len(head) :]
            if part.isascii():
                part = part.lower() if marks and part.isalpha() else self._lowered(part)
            if part == word:
                whole.append(word)
            else:
                plain[word] = part
        self._learn({*whole, *plain.values(), *tails.values()})
        known.update((w, known[p] + known[tails[w]] if w in tails else known[p]) for w, p in plain.items())
        return [b"".join(map(known.__getitem__, words)) for words in cut]


_encoders: dict[str, WordEncoder] = {}


def _encoder(tokenizer: str) -> WordEncoder:
    name = hashlib.sha256(tokenizer.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = WordEncoder(tokenizer)
    return _encoders[name]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialised id arrays; too few samples serve as they are, none gives none."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _zstd(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _quantiles(docs: DataFrame, key: str, parts: int) -> np.ndarray:
    if parts < 2:
        return np.zeros(0, np.int64)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts <= 1000 else F.expr(
        f"transform(sequence(1, {parts - 1}), i -> cast(i as double) / {parts})"
    )
    cut = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts))).head()[0]
    return np.array(cut or [], np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append the end id, and write the store at ``path``.

    Null texts are empty and consist of the end id. Null keys come first;
    repeated keys stand side by side, ordered by their ids' checksum. An empty
    table gives a store without blocks.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        tokenizer = file.read()
    encoder = WordEncoder(tokenizer)
    end = END_ID.to_bytes(encoder.width, "little")
    sampled = docs.filter(F.pmod(F.xxhash64(key), F.lit(SAMPLE_SHARE)) == 0).limit(SAMPLE_DOCS)
    texts = [r[0] for r in sampled.select(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE_CHARS)).collect()]
    dictionary = train_dictionary([ids + end for ids in encoder.encode(texts)])
    digest = hashlib.sha256(dictionary).hexdigest()

    rows = docs.count()
    parts = min(MAX_PARTS, max(1, -(-rows // PART_ROWS)))
    bounds = _quantiles(docs, key, parts)
    shipped = spark.sparkContext.broadcast((tokenizer, dictionary, bounds))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, dictionary, bounds = shipped.value
        compressor = zstandard.ZstdCompressor(level=LEVEL, **_zstd(dictionary))
        words, turn = _encoder(tokenizer), 0
        for batch in batches:
            ids = [i + end for i in words.encode(batch.column(1).to_pylist())]
            keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            # a key that fills whole parts is dealt over them in turn
            place = first + 1 + (np.arange(turn, turn + len(keys)) % np.maximum(last - first, 1))
            turn += len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(last > first, place, first).astype(np.int32)),
                    batch.column(0),
                    pa.array([len(i) // words.width for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([compressor.compress(i) for i in ids], pa.binary()),
                ],
                names=["part", "doc_id", "n_tokens", "crc", "frame"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, size, held = -1, 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            keys, counts, frames = zip(*held)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            real = [k for k in keys if k is not None] or [None]
            row = (part, block, real[0], real[-1], before, sum(counts), digest, keys, counts, offsets, b"".join(frames))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS
            )

        for batch in batches:
            for at, key, count, frame in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (at != part or size + len(frame) > BLOCK_BYTES):
                    yield flush()
                    before += sum(h[1] for h in held)
                    block, size, held = block + 1, 0, []
                if at != part:
                    part, block, before = at, 0, 0
                held.append((key, count, frame))
                size += len(frame)
        if held:
            yield flush()

    encoded = docs.select(F.col(key).cast("bigint"), text).mapInArrow(
        encode, "part int, doc_id bigint, n_tokens bigint, crc bigint, frame binary"
    )
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(
        "part", F.asc_nulls_first("doc_id"), "crc", "n_tokens"
    )
    ordered.select("part", "doc_id", "n_tokens", "frame").mapInArrow(pack, _BLOCKS_DDL).write.parquet(f"{path}/blocks")
    spark.createDataFrame(
        [(digest, bytearray(dictionary), encoder.width)], "sha256 string, content binary, id_bytes int"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # MAX_PARTS rows at most
    totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


def _decode(blocks: DataFrame, path: str, only: set[int] | None = None) -> DataFrame:
    """The documents of blocks that carry their part's ``start``; ids are little-endian unsigned 32-bit integers."""
    spark = blocks.sparkSession
    sha, content, width = spark.read.parquet(f"{path}/dictionary").head()
    shipped = spark.sparkContext.broadcast(bytes(content))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(**_zstd(shipped.value))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("the block was written with another dictionary")
                starts = row["start"] + row["before"] + np.concatenate([[0], np.cumsum(row["n_tokens"])])
                offsets, frames = row["offsets"], memoryview(row["frames"])
                chosen = [i for i, d in enumerate(row["doc_ids"]) if only is None or d in only]
                ids = [expand.decompress(frames[offsets[i] : offsets[i + 1]]) for i in chosen]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"][i] for i in chosen], pa.int64()),
                        pa.array(starts[chosen], pa.int64()),
                        pa.array([row["n_tokens"][i] for i in chosen], pa.int64()),
                        pa.array([np.frombuffer(i, f"<u{width}").astype("<u4").tobytes() for i in ids], pa.binary()),
                    ],
                    schema=_DOCS,
                )

    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/blocks").join(F.broadcast(parts), "part")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: ``(doc_id, start, n_tokens, ids)``; start counts the ids of all before it."""
    return _decode(_blocks(spark, path), path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents of a store: only their blocks are read and only their frames expanded."""
    wanted = F.lit(False)
    for i in doc_ids:
        wanted = wanted | F.lit(i).between(F.col("first_doc"), F.col("last_doc"))
    return _decode(_blocks(spark, path).filter(wanted), path, set(doc_ids))
