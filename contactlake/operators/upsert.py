"""K1: upserts without a merge-capable table format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def latest_by_key(df: DataFrame, key: str | Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """The row with the greatest ``version`` of each key; ties go to the greatest row.

    An aggregate, not a window: a key with very many versions is reduced in
    every task before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    versions = [version] if isinstance(version, str) else list(version)
    comparable = [F.to_json(c) if kind.startswith(("map", "variant")) else F.col(c) for c, kind in df.dtypes if c not in keys]
    rank = F.struct(*versions, F.struct(*comparable))
    best = df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(
    old: DataFrame, new: DataFrame, key: str = "lead_id", version: str | Sequence[str] = "ingested_at"
) -> DataFrame:
    """INSERT OR REPLACE: rows of ``new`` replace rows of ``old`` by key.

    Several new rows of one key collapse to the latest of them; columns that
    only ``new`` has may order them and are not stored. Old rows are
    only filtered (an anti join on the key), not rewritten through a sort.
    """
    fresh = latest_by_key(new, key, version).select(*old.columns)
    kept = old.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)
