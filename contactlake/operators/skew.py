"""Joining rows to one-row-per-key facts when a key may be very hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: a key is heavy when it holds more than 1/HEAVY_KEYS of all rows, hence at
#: most HEAVY_KEYS keys are heavy: the broadcast side is bounded by this
HEAVY_KEYS = 10_000
#: so many narrow rows of one key are no burden for one task
HEAVY_FLOOR = 1_000_000
#: what keys are counted by before any is counted by itself
COUNT_BUCKETS = 1 << 15


def heavy_cut(total_rows: int, floor: int = HEAVY_FLOOR) -> int:
    """Keys of more rows than this are heavy; at most ``HEAVY_KEYS`` can be."""
    return max(floor, total_rows // HEAVY_KEYS)


def attach_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total_rows: int,
    floor: int = HEAVY_FLOOR,
) -> DataFrame:
    """Inner-join ``rows`` with ``facts`` (unique per key) without a hot task.

    ``size`` is the facts column with the number of rows of that key. Rows of
    heavy keys never go through the shuffle: they meet a broadcast of the
    heavy facts, of which there are at most ``HEAVY_KEYS``. The others are
    shuffled by key, and the largest of them is a small share of the total.
    """
    cut = heavy_cut(total_rows, floor)
    if total_rows <= cut:
        return rows.join(facts, keys)
    heavy = facts.filter(F.col(size) > cut)
    light = facts.filter(F.col(size) <= cut)
    hot = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return hot.unionByName(rest)


def hot_keys(rows: DataFrame, keys: list[str], cut: int) -> DataFrame | None:
    """The keys of more than ``cut`` rows; None where there are none.

    Keys are counted by bucket, which sends one number per bucket and task;
    only those of overfull buckets are counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS))
    counted = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    if not (full := [r["_bucket"] for r in counted.filter(F.col("_rows") > cut).collect()]):
        return None
    some = rows.filter(bucket.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return some.filter(F.col("_rows") > cut).select(*keys)


def known(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Rows left-joined with ``facts`` (unique per key); those of ``hot`` keys meet a broadcast."""
    if hot is None:
        return rows.join(facts, key, "left")
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    light = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left")
    return light.unionByName(rows.join(F.broadcast(hot), key, "left_semi").join(few, key, "left"))
