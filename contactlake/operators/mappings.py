"""M6, M8: mappings as tables.

A mapping table has the columns ``source, ordinal, field, transform``; a
mapping log adds ``version, state`` and is append-only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake import vocab
from contactlake.operators.projection import FieldMapping

APPROVED, INVALIDATED = "approved", "invalidated"
MAPPING_SCHEMA = "source string, ordinal int, field string, transform string"

NO_MAPPING = "the mapping is empty"
UNKNOWN_FIELD = "mapped field does not exist in the source: "
NO_CONTACT = "the mapping identifies neither an email nor a phone field"
NO_NAME = "the mapping identifies no name field"


def to_table(spark: SparkSession, mappings: Mapping[str, FieldMapping]) -> DataFrame:
    rows = [
        (source, i, field, transform)
        for source, mapping in mappings.items()
        for i, (field, transform) in enumerate(mapping.items(), 1)
    ]
    return spark.createDataFrame(rows, MAPPING_SCHEMA)


def from_table(table: DataFrame) -> dict[str, dict[str, str]]:
    """Collect a mapping table for use as a plan parameter (one row per field)."""
    out: dict[str, dict[str, str]] = {}
    for row in sorted(table.select("source", "ordinal", "field", "transform").collect()):
        out.setdefault(row.source, {})[row.field] = row.transform
    return out


def judge_proposals(proposal: DataFrame, profile: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """M6 for every key at once, in one aggregate: ``(keys, reason, mapping)``, one row per profiled key.

    ``reason`` is NULL when the proposal is accepted, and ``mapping`` then has
    its (ordinal, field, transform) with unknown transforms turned to
    ``ignore`` and unlisted fields completed with ``ignore`` after the proposed
    ones.
    """
    given = profile.select(
        *keys, "field", F.col("ordinal").cast("int").alias("seen"), F.lit(None).cast("int").alias("ordinal"),
        F.lit(None).cast("string").alias("transform"),
    )
    asked = proposal.select(*keys, "field", F.lit(None).cast("int").alias("seen"), F.col("ordinal").cast("int"), "transform")
    allowed = F.when(F.col("transform").isin(*vocab.TRANSFORMS), F.col("transform")).otherwise("ignore").alias("transform")
    sides = (
        given.unionByName(asked)
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("seen").isNotNull(), F.struct("seen", "field")))).alias("_real"),
            F.sort_array(F.collect_list(F.when(F.col("seen").isNull(), F.struct("ordinal", "field", allowed)))).alias("_asked"),
        )
        .filter(F.size("_real") > 0)
    )
    real, listed = (F.transform(c, lambda x: x["field"]) for c in ("_real", "_asked"))
    wrong = F.get(F.array_except(listed, real), F.lit(0))

    def has(*transforms: str) -> Column:
        return F.exists("_asked", lambda x: x["transform"].isin(*transforms))

    last = F.array_max(F.transform("_asked", lambda x: x["ordinal"]))
    others = F.filter("_real", lambda r: ~F.array_contains(listed, r["field"]))
    added = F.transform(
        others, lambda r: F.struct((last + r["seen"]).alias("ordinal"), r["field"].alias("field"), F.lit("ignore").alias("transform"))
    )
    reason = (
        F.when(F.size("_asked") == 0, F.lit(NO_MAPPING))
        .when(wrong.isNotNull(), F.concat(F.lit(UNKNOWN_FIELD), wrong))
        .when(~has("email", "phone"), F.lit(NO_CONTACT))
        .when(~has("split_full_name", "first_name"), F.lit(NO_NAME))
    )
    return sides.select(*keys, reason.alias("reason"), F.concat("_asked", added).alias("mapping")).withColumn(
        "mapping", F.when(F.col("reason").isNull(), F.col("mapping"))
    )


def validate_mappings(
    proposal: DataFrame, profile: DataFrame, keys: tuple[str, ...] = ("source",)
) -> tuple[DataFrame, DataFrame]:
    """``judge_proposals`` as two tables: the verdicts per key, and the accepted mappings, a row per field."""
    judged = judge_proposals(proposal, profile, keys)
    return judged.select(*keys, "reason"), judged.select(*keys, F.explode("mapping").alias("m")).select(*keys, "m.*")


def current_mappings(log: DataFrame) -> DataFrame:
    """M8: the mapping in force per source.

    The latest version wins; a source whose latest version is an invalidation
    has none. Aggregated first, so a source with a long history is reduced
    where its rows are.
    """
    latest = (
        log.groupBy("source")
        .agg(F.max("version").alias("version"), F.max_by("state", "version").alias("_state"))
        .filter(F.col("_state") == APPROVED)
        .select("source", "version")
    )
    return log.filter(F.col("state") == APPROVED).join(latest, ["source", "version"]).select(
        "source", "version", "ordinal", "field", "transform"
    )
