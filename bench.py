"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The raw feed is rendered and landed first (untimed), as the sources would
deliver it. Timed are the jobs on it: ingest with writing, the drift test, the
healing run, entity resolution with marking, the reports, and the whole ingest
job from the files of two sources.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contactlake import vocab  # noqa: E402
from contactlake.operators import drift, entities  # noqa: E402
from contactlake.operators.positions import AT, form_batches, landed_position, numbered_runs  # noqa: E402
from contactlake.operators.profiling import profile_source  # noqa: E402
from contactlake.operators.projection import canonicalize, split_valid  # noqa: E402
from contactlake.plans import healing, reports  # noqa: E402
from contactlake.plans.ingest import run_ingest  # noqa: E402
from contactlake.session import Scratch, build_session  # noqa: E402
from workload import feed  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BATCH = vocab.BATCH_SIZE


def main() -> None:
    settings = {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{CPUS}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    work = Scratch(spark, "bench")
    parts = int(CPUS)
    # landed raw lines, in as many files as there are cores
    for name, drifted in (("lines", False), ("drifting", True)):
        dealt = feed.feed_lines(spark, SF_DIR, drifted).repartitionByRange(parts, "seq")
        numbered_runs(dealt.sortWithinPartitions("source", "seq")).write.parquet(work.path(name))
    lines = spark.read.parquet(work.path("lines"))
    drifting = spark.read.parquet(work.path("drifting"))
    rows = lines.count()
    at = drifting.select("source", "seq", AT)
    numbers = form_batches(at, BATCH, place=landed_position).drop(AT)
    batches = work.put("batches", feed.parse_feed(drifting.drop(AT)).join(numbers, ["source", "seq"]))
    state: dict = {}
    # the same feed as the files of its sources
    files = {"facebook": "facebook_leads.jsonl", "landing_page": "landing_page.jsonl"}
    for source, name in files.items():
        drifting.filter(f"source = '{source}'").select("raw_line").write.text(f"{work.path('inbox')}/{name}")
    in_files = sum(drifting.filter(f"source = '{s}'").count() for s in files)

    def ingest():
        checked = canonicalize(feed.parse_feed(lines), vocab.KNOWN_MAPPINGS, feed.ingest_ts())
        state["leads"] = work.put("leads", split_valid(checked)[0], ("source",))

    def batching():
        form_batches(lines, BATCH, place=landed_position).write.format("noop").mode("overwrite").save()

    def profile():
        profile_source(batches).collect()

    def drift_test():
        drift.batch_health(batches, vocab.KNOWN_MAPPINGS).collect()

    def heal():
        healed = healing.heal(batches, vocab.KNOWN_MAPPINGS, feed.ingest_ts())
        work.put("healed", healed.leads)

    def run_files():
        run_ingest(spark, work.path("inbox"), work.path("lake"), "1", feed.ingest_ts(), files=files)

    def resolve():
        resolution = entities.resolve_entities(state["leads"])
        state["resolved"] = work.put("resolved", resolution.leads)

    def dashboard():
        table = state["resolved"]
        for report in (
            reports.totals, reports.status_by_source, reports.score_histogram, reports.latest_leads,
        ):
            report(table).collect()

    timings: dict[str, float] = {}
    jobs = {
        "ingest": ingest, "form_batches": batching, "profile": profile, "drift_test": drift_test,
        "heal": heal, "resolve_entities": resolve, "reports": dashboard, "run_ingest": run_files,
    }
    for name, job in jobs.items():
        started = time.monotonic()
        job()
        timings[name] = round(time.monotonic() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "ingest_rows_per_second": round(rows / timings["ingest"]),
                "run_ingest_rows_per_second": round(in_files / timings["run_ingest"]),
                "dedupe_leads_per_second": round(rows / timings["resolve_entities"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
