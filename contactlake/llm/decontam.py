"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping windows with an edit budget each. If a
stretch of text is within ``k`` edits of a window of ``m`` characters, they
share at least ``m + 1 - q * (k + 1)`` q-grams, and all of them on diagonals
(text position minus window position) that lie at most ``k`` apart. So shared
q-grams are counted in overlapping diagonal bands, bands that reach the bound
are kept, and an alignment restricted to the band decides.

The benchmark comes in blocks of a bounded size; the documents are read once
for each block, and a block's index is all that a task holds besides its texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contactlake.session import Scratch

Q = 8
#: characters of a window, steps between windows, and edits allowed in a full one
WINDOW = 72
STEP = 24
EDITS = 5
#: an item with fewer normalised characters cannot be told from chance and is not searched
MIN_CHARS = 24
#: diagonals in a band; bands start at every half of it, which exceeds EDITS
BAND = 16
#: normalised characters of the benchmark in a block, and of an item in a piece
BLOCK_CHARS = 1 << 20
PIECE_CHARS = 1 << 16
#: characters of text worked on at once
TEXT_CHARS = 1 << 20
HASH_BITS = 22
CANDIDATES = 20_000
#: parts documents from each other: no alignment within the budget crosses it
GAP = "\n" * (EDITS + 1)

#: ASCII white space and marks become spaces
_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def normalise(text: str | None) -> str:
    """Lower case, ASCII marks and white space as single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode()


def budget(length: int) -> int:
    return length * EDITS // WINDOW


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    """The q-grams of 8 characters as integers; equal grams are equal, others rarely are."""
    one = ((codes ^ (codes >> 8)) & 255).astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Index:
    """The windows of one block of items and where their q-grams stand."""

    item: np.ndarray
    offset: np.ndarray
    codes: list[np.ndarray]

    def __post_init__(self) -> None:
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(n) for n in self.length], np.int64)
        self.bound = self.length + 1 - Q * (self.edits + 1)
        grams = [_grams(c) for c in self.codes]
        counts = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.window = np.repeat(np.arange(len(counts)), counts)[order]
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts))[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << HASH_BITS, bool)
        self.maybe[_slot(self.keys)] = True

    def _hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions whose gram is in the index, and the gram's number, where enough of them lie close."""
        at = np.flatnonzero(self.maybe[_slot(grams)])
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        real = self.keys[key] == grams[at]
        at, key = at[real], key[real]
        # every stretch near a window has the least bound of hits within the longest window
        span = int((self.length + self.edits).max())
        least = int(self.bound.min())
        ahead = np.searchsorted(at, at + span) - np.arange(len(at))  # hits from here on within the span
        starts = np.flatnonzero(ahead >= least)
        live = np.zeros(len(at) + 1, np.int64)
        np.add.at(live, starts, 1)
        np.add.at(live, starts + ahead[starts], -1)
        close = np.cumsum(live[:-1]) > 0
        return at[close], key[close]

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, band) pairs that share as many q-grams as the lemma asks for."""
        none = np.zeros(0, np.int64)
        if len(codes) < Q or not len(self.keys):
            return none, none
        at, key = self._hits(_grams(codes))
        if not len(at):
            return none, none
        n = self.count[key]
        entry = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        window = self.window[entry]
        # a stretch may begin before the text's first character, on a negative diagonal
        half = (np.repeat(at, n) - self.place[entry] + WINDOW) // (BAND // 2)
        stride = len(codes) // (BAND // 2) + WINDOW
        own = window * stride + half
        cells, shared = np.unique(np.concatenate([own, own - 1]), return_counts=True)
        enough = shared >= self.bound[cells // stride]
        return cells[enough] // stride, (cells[enough] % stride) * (BAND // 2) - WINDOW

    def align(self, codes: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least edits of each window against the text in its band, and where that stretch ends."""
        edits, end = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
        width = BAND + 2 * EDITS
        pad = 2 * WINDOW + width
        text = np.concatenate([np.zeros(pad, np.uint32), codes, np.zeros(pad, np.uint32)])
        step = np.arange(width + 1, dtype=np.int16)
        for length in np.unique(self.length[window]):
            some = np.flatnonzero(self.length[window] == length)
            for i in range(0, len(some), CANDIDATES):
                part = some[i : i + CANDIDATES]
                pattern = np.stack([self.codes[w] for w in window[part]])
                base = diagonal[part] - EDITS + pad
                region = text[base[:, None] + np.arange(length + width)]
                cost = np.zeros((len(part), width + 1), np.int16)  # by characters read beyond the window's
                for r in range(length):
                    same = region[:, r : r + width + 1] if r + width + 1 <= region.shape[1] else region[:, r:]
                    miss = np.ones((len(part), width + 1), np.int16)
                    miss[:, : same.shape[1]] = same != pattern[:, r, None]
                    following = cost + miss
                    following[:, :-1] = np.minimum(following[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(following - step, axis=1) + step
                best = cost.argmin(axis=1)
                edits[part] = cost[np.arange(len(part)), best]
                end[part] = base - pad + length + best
        return edits, end

    def search(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, end, edits) of all windows found in a text."""
        codes = _codes(text)
        window, diagonal = self.bands(codes)
        edits, end = self.align(codes, window, diagonal)
        good = edits <= self.edits[window]
        return window[good], end[good], edits[good]


def _windows(rows: Iterable[tuple[int, int, str]]) -> Index:
    item, offset, codes = [], [], []
    for number, start, piece in rows:
        text = _codes(piece)
        last = max(0, len(text) - WINDOW)
        for at in sorted({*range(0, last + 1, STEP), last}):
            item.append(number)
            offset.append(start + at)
            codes.append(text[at : at + WINDOW])
    return Index(np.array(item, np.int64), np.array(offset, np.int64), codes)


def _pieces(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Normalised items in pieces of a bounded size that overlap by a window."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for number, content in zip(frame["item"], map(normalise, frame["text"])):
                if len(content) >= MIN_CHARS:
                    for at in range(0, max(1, len(content) - WINDOW), PIECE_CHARS):
                        out.append((number, at, content[at : at + PIECE_CHARS + WINDOW]))
            yield pd.DataFrame(out, columns=["item", "start", "piece"])

    known = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull())
    return known.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text")).mapInPandas(
        cut, "item bigint, start bigint, piece string"
    )


def _blocks(pieces: DataFrame) -> Iterator[Index]:
    held, size = [], 0
    for row in pieces.toLocalIterator():
        if held and size + len(row.piece) > BLOCK_CHARS:
            yield _windows(held)
            held, size = [], 0
        held.append(tuple(row))
        size += len(row.piece)
    if held:
        yield _windows(held)


def _batches(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Joined texts of a bounded size, where each begins, and its (number, offset)."""
    held, begins, marks, size = [], [], [], 0
    overlap = WINDOW + EDITS
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), TEXT_CHARS):
            part = text[at : at + TEXT_CHARS + overlap]
            if held and size + len(part) > TEXT_CHARS:
                yield GAP.join(held), np.array(begins), np.array(marks)
                held, begins, marks, size = [], [], [], 0
            held.append(part)
            begins.append(size)
            marks.append((number, at))
            size += len(part) + len(GAP)
    if held:
        yield GAP.join(held), np.array(begins), np.array(marks)


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Rows ``(row, key, item, item_start, doc_end, edits)``: every window found in a whole text.

    ``row`` is a hash of the text, so that different texts under one key stay
    apart; repeated rows are one. ``item_start`` is the window's place in the normalised item and ``doc_end``
    the end of the stretch in the normalised text. Null texts are empty and
    match nothing; null items and items under ``MIN_CHARS`` are not searched;
    equal items each match; empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    schema = "row bigint, key bigint, item bigint, item_start bigint, doc_end bigint, edits int"
    fields = pa.schema([
        ("row", pa.int64()), ("key", pa.int64()), ("item", pa.int64()), ("item_start", pa.int64()),
        ("doc_end", pa.int64()), ("edits", pa.int32()),
    ])
    path = scratch.path("matches")
    given = docs.select(
        F.xxhash64(text).alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")
    )
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    for index in _blocks(_pieces(benchmark, item, item_text)):
        shipped = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                rows, keys = batch.column(0).to_numpy(), batch.column(1)
                texts = [normalise(t) for t in batch.column(2).to_pylist()]
                for joined, begins, marks in _batches(texts):
                    window, end, edits = index.search(joined)
                    if not len(window):
                        continue
                    part = np.searchsorted(begins, end - 1, "right") - 1
                    doc = marks[part, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows[doc]), keys.take(pa.array(doc)), pa.array(index.item[window]),
                            pa.array(index.offset[window]), pa.array(end - begins[part] + marks[part, 1]),
                            pa.array(edits.astype(np.int32)),
                        ],
                        schema=fields,
                    )

        given.mapInArrow(search, schema).write.mode("append").parquet(path)
        shipped.unpersist()
    return spark.read.schema(schema).parquet(path).distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per contaminated key and text: items met, windows found, and the least edits of one."""
    found = matches(docs, benchmark, key, text, item, item_text)
    by_item = found.groupBy("row", "key", "item").agg(
        F.countDistinct("item_start").alias("windows"), F.min("edits").alias("edits")
    )
    return by_item.groupBy("row", "key").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("windows").cast("bigint").alias("n_windows"),
        F.min("edits").alias("least_edits"),
    ).select("row", F.col("key").alias(key), "n_items", "n_windows", "least_edits")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents in which no passage was found; other columns stay as they are.

    Rows are searched and dropped where they are read, without a join; a
    benchmark of several blocks takes a written pass for each. ``key`` only
    serves the other reports.
    """
    scratch, place = Scratch(docs.sparkSession, "clean"), docs.columns.index(text)
    for number, index in enumerate(_blocks(_pieces(benchmark, item, item_text))):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = [normalise(t) for t in batch.column(place).to_pylist()]
                for joined, begins, marks in _batches(texts):
                    _, end, _ = index.search(joined)
                    keep[marks[np.searchsorted(begins, end - 1, "right") - 1, 0]] = False
                yield batch.filter(pa.array(keep))

        if number:
            docs = scratch.put(f"block{number}", docs)
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
