"""The aggregates and latest-row lists of the dashboard and run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _status_count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def totals(leads: DataFrame) -> DataFrame:
    """A1."""
    return leads.agg(
        F.count(F.lit(1)).alias("total"),
        _status_count("clean").alias("clean"),
        _status_count("flagged").alias("flagged"),
        _status_count("duplicate").alias("dupes"),
        F.round(F.avg("quality_score"), 1).alias("avg_score"),
    )


def status_by_source(leads: DataFrame) -> DataFrame:
    """A2."""
    return (
        leads.groupBy("source")
        .agg(
            _status_count("clean").alias("clean"),
            _status_count("flagged").alias("flagged"),
            _status_count("duplicate").alias("duplicate"),
        )
        .orderBy("source")
    )


def score_histogram(leads: DataFrame, width: int | None = 10) -> DataFrame:
    """A3: non-duplicates per score bucket.

    ``width=10`` buckets by tens. ``width=None`` divides without rounding, as
    the dashboard statement does, which gives one bucket per score.
    """
    score = F.col("quality_score")
    bucket = score / 10 * 10 if width is None else F.floor(score / width) * width
    return (
        leads.filter(F.col("status") != "duplicate")
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("leads"))
        .orderBy("bucket")
    )


def latest_events(events: DataFrame, n: int = 20) -> DataFrame:
    """A4; equal times are ordered by source, event and attempt."""
    return (
        events.select("ts", "source", "event", "attempt", "detail")
        .orderBy(F.desc("ts"), "source", "event", "attempt")
        .limit(n)
    )


def latest_leads(leads: DataFrame, n: int = 200) -> DataFrame:
    """A5; equal times are ordered by ``lead_id``."""
    shown = [
        "first_name", "last_name", "email", "phone_e164", "source", "campaign_id",
        "consent", "created_at", "quality_score", "status", "flags",
    ]
    return (
        leads.select("ingested_at", "lead_id", *shown)
        .orderBy(F.desc("ingested_at"), "lead_id")
        .limit(n)
        .select(*shown)
    )


def latest_reviews(review: DataFrame, n: int = 100) -> DataFrame:
    """A6; equal times are ordered by source and payload."""
    return (
        review.select("ts", "source", "reason", "raw_payload")
        .orderBy(F.desc("ts"), "source", "raw_payload")
        .limit(n)
    )


def run_report(checked: DataFrame) -> DataFrame:
    """Per source the rows read, stored, flagged and failed.

    Takes the output of ``canonicalize``, where failed rows still carry their
    violations.
    """
    valid = F.size("violations") == 0
    return (
        checked.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(valid).alias("stored"),
            F.count_if(valid & (F.col("status") == "flagged")).alias("flagged"),
            F.count_if(~valid).alias("failed"),
        )
        .orderBy("source")
    )


def run_totals(checked: DataFrame, leads: DataFrame, seconds: float) -> DataFrame:
    """Rows and rows per second of the run, and what the table holds."""
    none = F.lit(0).cast("bigint")
    rows = checked.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", none.alias("table_rows"), none.alias("table_clean")
    )
    held = leads.agg(
        F.count(F.lit(1)).alias("table_rows"), _status_count("clean").alias("table_clean")
    ).select(none.alias("rows"), "table_rows", "table_clean")
    both = rows.unionByName(held).agg(
        *[F.sum(c).alias(c) for c in ("rows", "table_rows", "table_clean")]
    )
    spent = F.greatest(F.lit(float(seconds)), F.lit(0.01))
    return both.select(
        "rows",
        F.lit(float(seconds)).alias("seconds"),
        (F.col("rows") / spent).alias("rows_per_second"),
        "table_rows",
        "table_clean",
    )


def clean_rate(leads: DataFrame) -> DataFrame:
    """A9."""
    return leads.agg(F.avg((F.col("status") == "clean").cast("int")).alias("clean_rate"))
