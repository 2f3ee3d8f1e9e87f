"""Table contracts (K5): the canonical table and its two side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


LEADS = T.StructType(
    [
        T.StructField("lead_id", T.StringType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone_e164", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("consent", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("quality_score", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

HEAL_EVENTS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("detail", T.StringType()),
    ]
)

REVIEW_QUEUE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
    ]
)

RUN_REPORTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in ("rows", "stored", "flagged", "failed")],
    ]
)

LEAD_COLUMNS = tuple(LEADS.fieldNames())


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Project ``df`` onto a table contract, filling absent columns.

    ``defaults`` gives the value of an absent or NULL column (the ``ts`` and
    ``ingested_at`` defaults); run times are passed in as literals so a
    recomputed task writes the same rows.
    """
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for field in schema:
        value = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def heal_events(df: DataFrame, ts: Column) -> DataFrame:
    """K2: heal events with the attempt default applied."""
    return conform(df, HEAL_EVENTS, {"ts": ts, "attempt": F.lit(0), "detail": F.lit("")})


def review_rows(df: DataFrame, ts: Column) -> DataFrame:
    """K3: review rows."""
    return conform(df, REVIEW_QUEUE, {"ts": ts})
