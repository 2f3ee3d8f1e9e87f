"""The ingest job: feeds to canonical leads, side tables and a run report."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake import model, vocab
from contactlake.operators import mappings as M
from contactlake.operators.drift import batch_health
from contactlake.operators.memory import remember_fields
from contactlake.operators.positions import form_batches
from contactlake.operators.projection import FieldMapping, canonicalize, split_valid
from contactlake.operators.upsert import latest_by_key
from contactlake.plans import healing, reports
from contactlake.session import Scratch, configure
from contactlake.sources import feeds
from contactlake.sources.tables import FieldMemory, LeadsTable, MappingLog, RunTable

#: more events than a batch can have
MAX_STEPS = 32


@dataclass(frozen=True)
class Tables:
    leads: LeadsTable
    heal_events: RunTable
    review_queue: RunTable
    mappings: MappingLog
    memory: FieldMemory
    run_reports: RunTable

    @classmethod
    def under(cls, spark: SparkSession, root: str) -> Tables:
        return cls(
            LeadsTable(spark, f"{root}/leads"),
            RunTable(spark, f"{root}/heal_events", model.HEAL_EVENTS),
            RunTable(spark, f"{root}/review_queue", model.REVIEW_QUEUE),
            MappingLog(spark, f"{root}/mappings"),
            FieldMemory(spark, f"{root}/memory"),
            RunTable(spark, f"{root}/run_reports", model.RUN_REPORTS),
        )


def ingest_fixed(
    batches: DataFrame, mappings: Mapping[str, FieldMapping], ingest_ts: Column,
    sources: tuple[str, ...] = vocab.SOURCES, identity: tuple[str, ...] = ("source", "seq", "raw_line"),
) -> tuple[DataFrame, DataFrame]:
    """Fixed mappings, no healing: ``(checked rows, review rows)``.

    Drifted batches are queued whole (the reference mode dropped them), failed
    rows one by one.
    """
    drifted = batch_health(batches, mappings, sources=sources).filter("drifted").select("source", "batch_id")
    in_drift = batches.join(drifted, ["source", "batch_id"], "left_semi")
    fit = batches.join(drifted, ["source", "batch_id"], "left_anti")
    checked = canonicalize(fit, mappings, ingest_ts, identity=identity, keep=("seq",), sources=sources)
    _, failed = split_valid(checked)
    queue = in_drift.select(
        "source", F.lit("mapping drift").alias("reason"), F.to_json("rec").alias("raw_payload")
    ).unionByName(
        failed.select(
            "source",
            F.lit("row validation failed").alias("reason"),
            F.coalesce("raw_payload", F.to_json(F.struct("raw_line"))).alias("raw_payload"),
        )
    )
    return checked, model.review_rows(queue, ingest_ts)


def run_ingest(
    spark: SparkSession,
    folder: str,
    root: str,
    run: str,
    ingest_ts: Column,
    files: Mapping[str, str] = vocab.FEED_FILES,
    only: tuple[str, ...] | None = None,
    batch_size: int = vocab.BATCH_SIZE,
    skip: int = 0,
    limit: int | None = None,
    fixed: Mapping[str, FieldMapping] | None = None,
    mapper: healing.Mapper | None = None,
) -> DataFrame:
    """Read, batch, map (healing unless ``fixed`` mappings are given), store.

    ``files`` names the sources, which the contract then accepts. A run that is
    executed again starts from what earlier runs learned and replaces its own
    events, review rows and log entries; numeric run names are ordered as
    numbers. Stores the counts per source (A7) and returns the run totals (A8).
    """
    configure(spark)
    started = time.monotonic()
    tables, scratch = Tables.under(spark, root), Scratch(spark, "ingest")
    landed = feeds.land(feeds.read_all(spark, folder, files, only), scratch.path("landed"))
    batches = form_batches(feeds.with_places(landed, scratch), batch_size, skip=skip, limit=limit)
    if fixed is not None:
        checked, review = ingest_fixed(batches, fixed, ingest_ts, tuple(files), feeds.IDENTITY)
        leads, _ = split_valid(checked)
        events = spark.createDataFrame([], model.HEAL_EVENTS)
    else:
        options = {"mapper": mapper} if mapper else {}
        known = tables.mappings.current(before_run=run)
        memory = scratch.put("memory", tables.memory.read(before_run=run))
        healed = healing.heal(
            batches, known, ingest_ts, memory=None if memory.isEmpty() else memory, sources=tuple(files), keep=("seq",),
            identity=feeds.IDENTITY, scratch=scratch, **options,
        )
        leads, review, events = healed.leads, healed.review, healed.event_rows(ingest_ts)
        checked = healed.checked
        store_mappings(spark, tables.mappings, healed, run)
        store_memory(tables.memory, healed, run)
    tables.leads.insert(leads)
    tables.heal_events.write(events, run)
    tables.review_queue.write(review, run)
    tables.run_reports.write(reports.run_report(checked), run)
    totals = scratch_free(reports.run_totals(batches, tables.leads.read(), time.monotonic() - started))
    scratch.drop()
    return totals


def scratch_free(report: DataFrame) -> DataFrame:
    """A report of a few rows as it is now, whatever becomes of the tables behind it."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def _versioned(events: DataFrame, last: int) -> DataFrame:
    """Events with versions in the order of batch and step, above ``last``."""
    return events.withColumn("version", F.lit(last) + F.col("batch_id") * MAX_STEPS + F.col("step") + 1)


def _pairs() -> Column:
    """The (ordinal, field, transform) of a mapping text."""
    return F.transform(
        F.from_json("mapping", "array<array<string>>"),
        lambda p, i: F.struct((i + 1).cast("int").alias("ordinal"), p[0].alias("field"), p[1].alias("transform")),
    )


def store_memory(table: FieldMemory, healed: healing.Healed, run: str) -> None:
    """M9: remember the fields of every mapping that the run approved, with the samples of the batch it came from."""
    last = table.read(before_run=run).agg(F.max("version")).first()[0] or 0
    learned = _versioned(healed.learned, last).select(*healing.BATCH, "version", F.explode(_pairs()).alias("p"))
    fields = learned.select(*healing.BATCH, "version", "p.field", "p.transform")
    latest = latest_by_key(fields.withColumn("id", F.concat("source", F.lit("::"), "field")), "id", "version").drop("id")
    sampled = healed.profiles.select(*healing.BATCH, "field", "samples")
    rows = remember_fields(latest.drop("batch_id"), latest.join(sampled, [*healing.BATCH, "field"]).select("source", "field", "samples", "version"), F.col("version"))
    table.write(rows, run)


def store_mappings(spark: SparkSession, log: MappingLog, healed: healing.Healed, run: str) -> None:
    """Append what the run learned and invalidated to the mapping log, in versions by batch and step."""
    last = log.read(before_run=run).agg(F.max("version")).first()[0] or 0
    versioned = _versioned(healed.events, last)
    approved = versioned.filter("mapping IS NOT NULL").select(
        "source", "version", F.lit(M.APPROVED).alias("state"), F.explode(_pairs()).alias("p")
    )
    gone = versioned.filter(F.col("event").isin("drift_detected", "human_review"))
    nothing = {"ordinal": F.lit(None).cast("int"), "field": F.lit(None).cast("string"), "transform": F.lit(None).cast("string")}
    invalid = gone.select("source", "version", F.lit(M.INVALIDATED).alias("state")).withColumns(nothing)
    log.write(approved.select("source", "version", "state", "p.*").unionByName(invalid), run)
