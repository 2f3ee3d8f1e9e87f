"""Importance resampling towards a target distribution, over hashed n-grams.

A document is separator-normalised (ASCII letters lower-cased, words joined by
one space) and scanned once. The scan keeps the running CRC-32 at the start and
at the end of every word; the CRC of any run of words then follows from two of
these prefixes. CRCs are linear over GF(2): the earlier prefix, shifted by as
many zero bytes as the run is long, cancels out of the later one.

Buckets of these CRCs are counted over the whole corpus and over the target
texts. A document's weight is the mean log-ratio of its buckets, and documents
are drawn without replacement by the greatest sums of weight and Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contactlake.operators.positions import number_sorted
from contactlake.session import Scratch

#: the reflected polynomial of CRC-32
POLYNOMIAL = 0xEDB88320
#: runs of 1 to LONGEST words are features, hashed into BUCKETS
LONGEST, BUCKETS = 2, 10_000
#: documents of fewer words are never drawn; SHARE percent of the others are
MIN_WORDS, SHARE = 20, 25
SEED = 7
#: weights and noise are whole thousandths
SCALE = 1000
#: runs below this length have shift tables of their own
SHORT = 64
#: a long text is scanned in pieces of about so many bytes
PIECE = 1 << 18

#: bytes of words: digits, lower-case letters and everything beyond ASCII
_WORD = bytes(b for b in range(256) if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128)
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


@lru_cache(1)
def _byte_steps() -> np.ndarray:
    """What one more byte does to the low byte of a CRC register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1)
    return step


def _apply(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit words, given by its values on each of the four bytes."""
    out = tables[0][crcs & 255]
    for i in (1, 2, 3):
        out = out ^ tables[i][crcs >> np.uint32(8 * i) & 255]
    return out


@lru_cache(64)
def _shift_tables(power: int) -> np.ndarray:
    """The map that appends ``2 ** power`` zero bytes."""
    if power:
        half = _shift_tables(power - 1)
        return np.stack([_apply(half, t) for t in half])
    values = np.arange(256, dtype=np.uint32)
    registers = [values << np.uint32(8 * i) for i in range(4)]
    return np.stack([_byte_steps()[r & 255] ^ r >> np.uint32(8) for r in registers])


@lru_cache(1)
def _short_shifts() -> np.ndarray:
    """The maps that append 0 to ``SHORT`` - 1 zero bytes, one table each for the four bytes of a word."""
    values = np.arange(256, dtype=np.uint32)
    maps = [np.stack([values << np.uint32(8 * i) for i in range(4)])]
    for _ in range(SHORT - 1):
        maps.append(np.stack([_apply(_shift_tables(0), t) for t in maps[-1]]))
    return np.stack(maps, axis=1).reshape(4, SHORT * 256)


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC as it stands after so many more zero bytes, without the register's conditioning."""
    base = (np.minimum(lengths, SHORT - 1) << 8).astype(np.intp)
    tables, out = _short_shifts(), np.zeros_like(crcs)
    for i in range(4):
        out ^= tables[i].take(base + (crcs >> np.uint32(8 * i) & np.uint32(255)))
    for power in range((int(lengths.max(initial=0)) - SHORT + 1).bit_length() if lengths.max(initial=0) >= SHORT else 0):
        chosen = np.flatnonzero(np.maximum(lengths - SHORT + 1, 0) >> power & 1)
        out[chosen] = _apply(_shift_tables(power), out[chosen])
    return out


def run_crcs(first: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the runs between two prefixes: ``first`` cancels out of ``last``."""
    return last ^ shift(first, lengths)


class Prefixes:
    """Running CRCs at the word boundaries of a normalised text.

    ``starts[i]`` and ``ends[i]`` are the CRCs of all bytes before and up to
    the end of word ``i``; ``at[i]`` and ``to[i]`` are the places in bytes.
    ``text`` is a piece with one space before each word but the first of all.
    """

    def __init__(self, text: bytes, running: int = 0, offset: int = 0):
        ends, crc = [], running
        for word in text.replace(b" ", b"\n ").removeprefix(b"\n").split(b"\n"):
            crc = crc32(word, crc)
            ends.append(crc)
        self.ends = np.array(ends, np.uint32)
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        opened = text[:1] == b" "
        self.to = offset + np.append(spaces[opened:], len(text))
        self.at = offset + (spaces + 1 if opened else np.append(0, spaces + 1))
        # one more byte, the space, leads from a word's end to the next one's start
        before = np.append(np.uint32(running), self.ends[:-1]).astype(np.uint32)
        register = ~before
        self.starts = ~(_byte_steps()[(register ^ np.uint32(32)) & 255] ^ register >> np.uint32(8))
        if not opened:
            self.starts[0] = running
        self.running, self.offset = crc, offset + len(text)

    def after(self, earlier: Prefixes, keep: int) -> Prefixes:
        """With the last ``keep`` words of the piece before in front."""
        for name in ("starts", "ends", "at", "to"):
            before = getattr(earlier, name)
            setattr(self, name, np.concatenate([before[len(before) - min(keep, len(before)) :], getattr(self, name)]))
        return self


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; a word is never cut."""
    place = 0
    while place < len(text):
        end = len(text)
        if place + PIECE < end and (cut := _next_separator(text, place + PIECE)) >= 0:
            end = cut
        words = text[place:end].translate(_NORMAL).split()
        if words:
            yield words
        place = end


def _next_separator(text: bytes, place: int) -> int:
    """The first byte from ``place`` on that is in no word; -1: none."""
    while place < len(text):
        found = text[place : place + PIECE].translate(_NORMAL).find(b" ")
        if found >= 0:
            return place + found
        place += PIECE
    return -1


def features(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of a UTF-8 text its number of words and the CRCs of all runs that end in it."""
    held = None
    for words in _pieces(text):
        joined = b" ".join(words)
        if held is None:
            found = Prefixes(joined)
        else:
            found = Prefixes(b" " + joined, held.running, held.offset).after(held, longest - 1)
        carried, runs = len(found.ends) - len(words), []
        for n in range(1, longest + 1):
            low = max(carried - n + 1, 0)  # runs that end before this piece were given with the last one
            first, last = slice(low, max(len(found.starts) - n + 1, low)), slice(low + n - 1, None)
            runs.append(run_crcs(found.starts[first], found.ends[last], found.to[last] - found.at[first]))
        yield len(words), np.concatenate(runs)
        held = found


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over every run of words of all texts; each task sends its own totals only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                if (data := value.as_buffer()) is not None:
                    for _, crcs in features(data.to_pybytes(), longest):
                        totals += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the floored log-ratio of the smoothed shares, from two count tables of at most ``buckets`` rows."""
    counts = np.zeros((2, buckets))
    for row, table in zip(counts, (corpus, target)):
        found = table.toPandas()
        row[found["bucket"].to_numpy(np.int64)] = found["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    ratios = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST) -> Column:
    """``struct(n_words, n_features, weight)`` of every text: the floored mean gain of its features."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        table, rows = shipped.value, []
        for value in texts:
            words = found = total = 0
            for n, crcs in features((value or "").encode(), longest):
                words, found = words + n, found + len(crcs)
                total += int(table[crcs % np.uint32(len(table))].sum())
            rows.append((words, found, total // found if found else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    return weighed(F.col(text).cast("string"))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Whole thousandths of Gumbel noise, fixed by the key (null: no digits) and the seed."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every row's ``(key, n_words, n_features, weight, score, rank)``.

    ``share`` percent (rounded down) of the rows with ``min_words`` words or
    more are drawn: those of the greatest scores, ties by the smaller key, then
    by the text's checksum; their ``rank`` counts from 1, and is null
    elsewhere. Null and empty texts have no words and weigh 0, like texts of
    separators only; a null key is a key without digits, and comes before the
    others in a tie. Repeated rows each take part. An empty table gives an
    empty result, an empty target one in which rare features gain most. No
    other column is read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    weighed = scratch.put(
        "weighed",
        docs.select(
            F.col(key).alias("key"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"),
            weigh(docs, gain, text).alias("w"), gumbel(F.col(key), seed).alias("noise"),
        ).select("key", "tie", "w.*", (F.col("w.weight") + F.col("noise")).alias("score")),
    )
    eligible = weighed.filter(F.col("n_words") >= min_words)
    drawn = share * eligible.count() // 100
    ranked = number_sorted(eligible, [F.desc("score"), F.asc_nulls_first("key"), F.asc("tie")], scratch, "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    others = weighed.filter(F.col("n_words") < min_words).withColumn("place", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank).unionByName(others.withColumn("rank", F.col("place"))).select(
        F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank"
    )
