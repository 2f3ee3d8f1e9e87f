"""The feed as a stream of files, healed per micro-batch.

Every micro-batch writes under its own batch id and reads only the mapping
log of earlier ones, so a micro-batch that is run again after a failure
replaces its own output and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake import model, vocab
from contactlake.operators.positions import form_batches
from contactlake.plans import healing
from contactlake.plans.ingest import store_mappings
from contactlake.session import Scratch, configure
from contactlake.sources import feeds
from contactlake.sources.feeds import json_records
from contactlake.sources.tables import MappingLog, RunTable


def line_stream(spark: SparkSession, folder: str, source: str, files_per_batch: int = 1) -> DataFrame:
    """New files of a JSON-lines feed, a bounded number per micro-batch."""
    return (
        configure(spark)
        .readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select(F.lit(source).alias("source"), F.col("value").alias("raw_line"), *feeds.origin())
    )


def run_stream(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> None:
    """Process everything there is and stop (a paced replay without waiting)."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def heal_handler(
    spark: SparkSession,
    root: str,
    ingest_ts: Column,
    known: dict | None = None,
    batch_size: int = vocab.BATCH_SIZE,
    parse: Callable[[DataFrame], DataFrame] = json_records,
    **options,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that heals and stores one micro-batch.

    A lead's id comes from its file and its place there, so a line that is sent
    again in another file is another lead, and a micro-batch that is run again
    gives the same ones. Rows without a file are placed in their micro-batch.
    """
    log = MappingLog(spark, f"{root}/mappings")
    leads = RunTable(spark, f"{root}/leads", model.LEADS)
    events = RunTable(spark, f"{root}/heal_events", model.HEAL_EVENTS)
    review = RunTable(spark, f"{root}/review_queue", model.REVIEW_QUEUE)

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = f"{batch_id:012d}"
        scratch = Scratch(spark, "micro-batch")
        if "file" not in batch.columns:
            batch = batch.withColumns({"file": F.lit(run), "block": F.spark_partition_id().cast("bigint")})
        lines = batch.filter(feeds.written("raw_line")).withColumn("seq", F.monotonically_increasing_id())
        # written once: every job of this micro-batch reads the same rows
        landed = feeds.land(parse(lines), scratch.path("landed"))
        batches = form_batches(feeds.with_places(landed, scratch), batch_size)
        current = {**(known or {}), **log.current(before_run=run)}
        for gone in _invalidated(log, run):
            current.pop(gone, None)
        healed = healing.heal(batches, current, ingest_ts, identity=feeds.IDENTITY, scratch=scratch, **options)
        leads.write(model.conform(healed.leads, model.LEADS), run)
        events.write(healed.event_rows(ingest_ts), run)
        review.write(healed.review, run)
        store_mappings(spark, log, healed, run)
        scratch.drop()

    return handle


def _invalidated(log: MappingLog, run: str) -> list[str]:
    """Sources whose latest log entry before the run is an invalidation."""
    latest = log.read(before_run=run).groupBy("source").agg(F.max_by("state", "version").alias("state"))
    return [r.source for r in latest.filter("state = 'invalidated'").collect()]
