"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints
differ in at most two bits, they differ in at most one bit in some segment, so
every fingerprint looks up the Hamming ball of radius one around each of its
segments in a table of all segments, and the complete distance decides. Of two
segments that differ in one bit, exactly one has a zero there; enumerating only
the flips of zeros therefore finds each pair once and halves the ball.

A crowded table entry is not paired out: its probes enumerate the ball that
the distance still allows in the *other* segment and look the complete
fingerprints up, so a probe never meets more than ``1 + 32 + 496`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contactlake.llm.common import fresh
from contactlake.operators.entities import connected_components
from contactlake.operators.skew import attach_facts
from contactlake.session import Scratch

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENT_BITS = 32
#: a table entry with more fingerprints than a ball of radius two has keys
CROWDED = 1 + 32 + 496
#: words hashed at once, so that very long texts need no more memory
CHUNK_WORDS = 50_000


def _hashes(words: list[bytes], width: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), SEED)]
    return [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; no words give zero.

    ASCII letters are lower-cased, words are cut at ASCII white space, and a
    bit is set if it is set in over half of the shingle hashes, repeats
    included.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for start in range(0, max(1, len(words) - width + 1), CHUNK_WORDS):
        part = np.array(_hashes(words[start : start + CHUNK_WORDS + width - 1], width), "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _ball(value: Column, free: Column) -> Column:
    """All 32-bit values within ``free`` (0 to 2) flips of ``value``."""
    bits = F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))
    single = F.transform(bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    double = F.flatten(
        F.transform(single, lambda a: F.transform(F.filter(single, lambda b: b > a), lambda b: a.bitwiseOR(b)))
    )
    none = F.array().cast("array<bigint>")
    masks = F.concat(
        F.array(F.lit(0).cast("long")), F.when(free >= 1, single).otherwise(none), F.when(free >= 2, double).otherwise(none)
    )
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that differ in 1 to ``max_bits`` (at most 2) bits.

    ``prints`` has one row per fingerprint, in ``fp``.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with balls of radius one reach two bits at most")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    sides = F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("value"), low.alias("other")),
        F.struct(F.lit(1).alias("seg"), low.alias("value"), high.alias("other")),
    )
    segments = prints.select("fp", F.explode(sides).alias("s")).select("fp", "s.*")
    sizes = segments.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("entry_size"))
    crowded = scratch.put("crowded", sizes.filter(F.col("entry_size") > CROWDED).select("seg", "value"))
    crowds = crowded.count()  # at most 2 * fingerprints / CROWDED, hence a shuffle join below
    flips = F.transform(
        F.filter(
            F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)),
            lambda i: F.call_function("shiftright", F.col("value"), i).bitwiseAND(F.lit(1)) == 0,
        ),
        lambda i: F.struct(
            F.col("value").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("value"),
            F.lit(1).alias("flips"),
        ),
    )
    same = F.array(F.struct(F.col("value"), F.lit(0).alias("flips")))
    ball = F.concat(same, flips) if max_bits else F.array().cast("array<struct<value:bigint,flips:int>>")
    probes = segments.select("fp", "seg", "other", F.explode(ball).alias("p")).select("fp", "seg", "other", "p.*")
    entries = segments
    far = None
    if crowds:
        entries = segments.join(crowded, ["seg", "value"], "left_anti")
        dense = probes.join(crowded, ["seg", "value"])
        wanted = dense.select(
            F.col("fp").alias("a"), "seg", "value",
            F.explode(_ball(F.col("other"), F.lit(max_bits) - F.col("flips"))).alias("rest"),
        )
        left = F.when(F.col("seg") == 0, F.col("value")).otherwise(F.col("rest"))
        right = F.when(F.col("seg") == 0, F.col("rest")).otherwise(F.col("value"))
        whole = F.call_function("shiftleft", left, F.lit(SEGMENT_BITS)).bitwiseOR(right)
        far = wanted.select("a", whole.alias("fp")).join(prints.select("fp"), "fp").select("a", F.col("fp").alias("b"))
    met = probes.alias("p").join(entries.alias("e"), ["seg", "value"]).filter(
        F.bit_count(F.col("p.fp").bitwiseXOR(F.col("e.fp"))).between(1, max_bits)
        & ((F.col("flips") > 0) | (F.col("p.fp") < F.col("e.fp")))
    )
    found = met.select(F.col("p.fp").alias("a"), F.col("e.fp").alias("b"))
    found = found.unionByName(far.filter("a <> b")) if far is not None else found
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(
    docs: DataFrame, key: str, text: str, width: int, max_bits: int
) -> tuple[DataFrame, DataFrame]:
    """Stored rows ``(key, text_hash, fp)``, and per fingerprint its copies, least key and component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(
        "prints",
        docs.select(
            F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"),
            fingerprint_column(F.col(text), width).alias("fp"),
        ),
    )
    prints = scratch.put(
        "distinct", rows.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    pairs = scratch.put("links", links(prints, scratch, max_bits))
    parts = connected_components(pairs, scratch)
    grouped = prints.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "copies", F.coalesce("component", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, scratch.put("facts", grouped.join(least, "root").select("fp", "copies", "root", "component_id"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row ``(key, fingerprint, component_id)`` per input row.

    Rows link if their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest key reachable. Null and empty texts have
    fingerprint zero and link like any other. A null key is kept as a row and
    never is a component's id unless the component has no other key. Repeated
    rows stay repeated; an empty table gives an empty result; other columns
    are not looked at.
    """
    rows, facts = _components(docs, key, text, width, max_bits)
    joined = attach_facts(rows, facts, ["fp"], "copies", rows.count())
    return joined.select(
        F.col("key").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest key.

    Of rows that share that key the one with the least hash of its text stays,
    a null key stays only where no other is in its component, and of repeated
    rows one stays. All columns are kept.
    """
    rows, facts = _components(docs, key, text, width, max_bits)
    placed = attach_facts(rows, facts, ["fp"], "copies", rows.count())
    best = F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "text_hash")).alias("best")
    own_key, own_hash, text_hash = (fresh(docs, n) for n in ("own_key", "own_hash", "text_hash"))
    chosen = placed.groupBy("root").agg(best).select(
        F.col("best.key").alias(own_key), F.col("best.text_hash").alias(own_hash)
    )
    hashed = docs.withColumn(text_hash, F.xxhash64(text))
    # joined by the hash alone, so that the same shuffle serves the repeated rows
    same_key = F.coalesce(F.col(key) == F.col(own_key), F.col(key).isNull() & F.col(own_key).isNull())
    # the chosen keys grow with the rows, so they are never broadcast, whatever the size today
    kept = hashed.join(chosen.hint("merge"), (F.col(text_hash) == F.col(own_hash)) & same_key, "left_semi")
    return kept.dropDuplicates([text_hash, key]).drop(text_hash)
