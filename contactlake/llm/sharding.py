"""Shards of equal size by sampled splitters.

Rows are ordered by their key. A sample in which a row's chance follows its
size gives splitters whose ranges hold about equal sizes; ranges that turn out
overfull are subdivided by a second sample taken inside them. The ranges' exact
sizes are then summed, and running sums inside each range place every row, so a
shard ends within one row of its equal share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from contactlake.llm.common import fresh, utf8
from contactlake.session import Scratch

SHARDS = 24
#: bytes that a record has besides its text
RECORD_BYTES = 8
#: ranges aimed at: enough per shard, and few enough rows in each for one task
RANGES_PER_SHARD = 8
RANGE_ROWS = 50_000
MAX_RANGES = 20_000
#: sampled keys for each range
DRAWS = 20
#: a range beyond so many times its share is subdivided
OVERFULL = 2.0


@dataclass(frozen=True)
class Splitters:
    """Ascending boundaries; row keys are 24 bytes that sort as (key, tie, seq)."""

    keys: np.ndarray

    def place(self, key: Column, tie: Column, seq: Column) -> Column:
        """The number of the range that holds a row."""
        shipped = self.keys  # 24 bytes for each range

        @F.pandas_udf("int")
        def number(key: pd.Series, tie: pd.Series, seq: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(shipped, _sortable(key, tie, seq), "right").astype(np.int32))

        return number(key, tie, seq)


def _sortable(*columns: pd.Series) -> np.ndarray:
    """Signed integers as fixed-width bytes in the same order."""
    flipped = [c.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns]
    return np.ascontiguousarray(np.stack(flipped, axis=1).astype(">u8")).view("S24").ravel()


def _draw(rows: DataFrame, weight: Column) -> pd.DataFrame:
    """Sampled keys; a row's chance follows its weight, which is returned as drawn.

    Rows with a weight of one and more are always drawn. The number drawn is in
    the mean at most the sum of the weights.
    """
    chance = F.least(F.lit(1.0), weight)
    # the chance is decided by the row itself: a repeated task draws the same rows
    coin = F.pmod(F.xxhash64("tie", "seq", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(coin < chance).select("k", "tie", "seq", F.greatest(F.lit(1.0), weight).alias("w")).toPandas()


def _quantiles(sample: pd.DataFrame, ranges: int) -> np.ndarray:
    keys = _sortable(sample["k"], sample["tie"], sample["seq"])
    order = np.argsort(keys, kind="stable")
    keys, total = keys[order], np.cumsum(sample["w"].to_numpy()[order])
    if not len(keys) or ranges < 2:
        return keys[:0]
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[at])


def splitters(rows: DataFrame, n_rows: int, total: int, shards: int) -> Splitters:
    """Boundaries of ranges with about equal sizes, none far beyond its share."""
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-n_rows // RANGE_ROWS)))
    share = total / ranges
    drawn = _draw(rows, F.col("size") * F.lit(DRAWS / share))
    first = Splitters(_quantiles(drawn, ranges))
    placed = rows.withColumn("range", first.place(F.col("k"), F.col("tie"), F.col("seq")))
    full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    overfull = full.filter((F.col("n") > 1) & (F.col("bytes") > OVERFULL * share)).toPandas()  # of at most ``ranges`` rows
    if not len(overfull):
        return first
    numbers = rows.sparkSession.createDataFrame(overfull[["range"]], "range int")
    inside = placed.join(F.broadcast(numbers), "range", "left_semi")
    again = _draw(inside, F.col("size") * F.lit(4 * DRAWS / share))
    place = np.searchsorted(first.keys, _sortable(again["k"], again["tie"], again["seq"]), "right")
    more = [
        _quantiles(again[place == number], int(-(-size // share)))
        for number, size in zip(overfull["range"], overfull["bytes"])
    ]
    return Splitters(np.unique(np.concatenate([first.keys, *more])))


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row ``(key, size, text_crc32, shard, slot)``: shards 0 to ``shards`` - 1 of nearly equal bytes.

    Size is the text's bytes plus ``RECORD_BYTES``; a null text has no bytes.
    Shards are ranges of the key order: null keys first, repeated keys in the
    order of their texts' hashes, repeated rows anyhow. A row belongs to the
    shard in which the middle of its bytes falls, so shards differ by less than
    their largest rows; ``slot`` counts a shard's rows from 0 without gaps. An
    empty table gives an empty result; with few rows some shards stay empty.
    """
    return _place(docs, shards, key, text, F.monotonically_increasing_id()).drop("seq")


def _place(docs: DataFrame, shards: int, key: str, text: str, number: Column) -> DataFrame:
    """The shards of ``assign_shards`` with each row's own number as ``seq``."""
    scratch = Scratch(docs.sparkSession, "shards")
    keyed = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(utf8(text)).cast("bigint") + RECORD_BYTES).alias("size"),
        F.crc32(utf8(text)).alias("text_crc32"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("k"),
        F.xxhash64(text).alias("tie"),
        number.alias("seq"),  # stored below, so it is the same in every later job
    )
    rows = scratch.put("rows", keyed)
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    cut = splitters(rows, n_rows, max(total, 1), shards)
    placed = scratch.put("placed", rows.withColumn("range", cut.place(F.col("k"), F.col("tie"), F.col("seq"))))
    full = placed.groupBy("range").agg(F.sum("size").alias("bytes")).toPandas().sort_values("range")
    offsets = dict(zip(full["range"].tolist(), (full["bytes"].cumsum() - full["bytes"]).tolist()))
    offset = placed.sparkSession.createDataFrame(list(offsets.items()), "range int, before bigint")
    inside = Window.partitionBy("range").orderBy("k", "tie", "seq")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # the middle of a row lies before the end of all bytes, hence in a shard; doubled to stay whole
    summed = placed.withColumn("upto", upto).join(F.broadcast(offset), "range")
    doubled = 2 * (F.col("before") + F.col("upto")) - F.col("size")
    sharded = scratch.put(
        "sharded",
        summed.withColumn(
            "shard", F.floor(doubled.cast("decimal(38,0)") * shards / F.lit(2 * max(total, 1))).cast("int")
        ).select("key", "size", "text_crc32", "shard", "range", "k", "tie", "seq"),
    )
    # a shard is a run of ranges: rows before a range's part of the shard, by counts alone
    pieces = sharded.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))  # ranges + shards rows at most
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "range").orderBy("k", "tie", "seq")
    return (
        sharded.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(pieces), ["shard", "range"])
        .select(
            F.col("key").alias(key), "size", "text_crc32", "shard",
            (F.col("ahead") + F.col("rank") - 1).cast("bigint").alias("slot"), "seq",
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write the rows under ``shard=N`` folders, each file a run of a shard's slots in order.

    Rows find their shard by a number of their own that is stored with them, so
    null and repeated keys and repeated rows keep their count. Columns named
    ``shard`` and ``slot`` are replaced. An empty table writes no file of rows.
    """
    given = docs.drop("shard", "slot")
    number = fresh(given, "_row")
    numbered = given.withColumn(number, F.monotonically_increasing_id())
    rows = Scratch(docs.sparkSession, "numbered").put("rows", numbered)
    placed = _place(rows, shards, key, text, F.col(number)).select(F.col("seq").alias(number), "shard", "slot")
    joined = rows.join(placed, number).drop(number)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
