"""The ingest job and the stream over files."""

import json

from pyspark.sql import functions as F

from contactlake import model, vocab
from contactlake.plans.ingest import Tables, run_ingest
from contactlake.sources.tables import MappingLog, RunTable
from contactlake.streaming import replay


def ts():
    return F.lit("2026-08-01 00:00:00").cast("timestamp")


def webhook(i, name_key="full_name", phone_key="phone_number"):
    fields = [(name_key, "Ann Lee"), ("email", f"ann{i}@acme.com"), (phone_key, f"688937{i:04}")]
    value = {
        "campaign_id": "23851234567890789",
        "created_time": "2026-07-16T13:35:00+0000",
        "field_data": [{"name": n, "values": [v]} for n, v in fields],
    }
    return json.dumps({"entry": [{"changes": [{"value": value}]}]})


def landing(i):
    return json.dumps({
        "fname": "Ann", "lname": "Lee", "email_addr": f"ann{i}@acme.com", "mobile": f"688937{i:04}",
        "utm_campaign": "lp", "opt_in": True, "submitted_at": "2026-07-05T03:08:00Z",
    })


def test_ingest_heals_stores_and_is_repeatable(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "lake")
    inbox.mkdir()
    lines = [webhook(i) for i in range(40)]
    lines += [webhook(i, "applicant_name", "contact_phone") for i in range(40, 80)] + ["{broken"]
    (inbox / "facebook_leads.jsonl").write_text("\n".join(lines))
    (inbox / "landing_page.jsonl").write_text("\n".join(landing(i) for i in range(30)))
    (inbox / "google_form.csv").write_text(
        "Timestamp,What's your name?,Best number to reach you,Your email address\n"
        + "".join(f"08-Jul-2026,Bo Bell,6889370{i:03},bo{i}@bigco.io\n" for i in range(20))
    )
    total = run_ingest(spark, str(inbox), root, "1", ts(), batch_size=20).first()
    assert (total.rows, total.table_rows, total.table_clean) == (131, 130, 130)
    tables = Tables.under(spark, root)
    events = tables.heal_events.read().groupBy("source", "event").count().collect()
    assert sorted((r.source, r.event, r["count"]) for r in events) == [
        ("facebook", "drift_detected", 1), ("facebook", "healed", 1), ("facebook", "mapping_learned", 1),
        ("facebook", "retry", 1), ("google_form", "mapping_learned", 1), ("landing_page", "mapping_learned", 1),
    ]
    assert [r.reason for r in tables.review_queue.read().collect()] == ["unreadable record"]
    assert tables.mappings.current()["facebook"]["contact_phone"] == "phone"
    remembered = {r.id: r.transform for r in tables.memory.read().collect()}
    assert remembered["facebook::contact_phone"] == "phone" and remembered["landing_page::fname"] == "first_name"
    reported = {r.source: (r.rows, r.stored, r.failed) for r in tables.run_reports.read().collect()}
    assert reported == {"facebook": (80, 80, 0), "google_form": (20, 20, 0), "landing_page": (30, 30, 0)}
    # the same files again: same ids, so nothing is added
    again = run_ingest(
        spark, str(inbox), root, "2", ts(), batch_size=20, fixed=vocab.KNOWN_MAPPINGS, only=("landing_page",)
    ).first()
    assert (again.rows, again.table_rows) == (30, 130)


def test_stream_heals_across_micro_batches_and_replays(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "lake")
    inbox.mkdir()
    (inbox / "a.jsonl").write_text("\n".join(webhook(i) for i in range(10)))
    handle = replay.heal_handler(spark, root, ts(), known=vocab.KNOWN_MAPPINGS)
    stream = replay.line_stream(spark, str(inbox), "facebook")
    replay.run_stream(stream, str(tmp_path / "check"), handle)
    (inbox / "b.jsonl").write_text("\n".join(webhook(i, "applicant_name", "contact_phone") for i in range(10, 25)))
    replay.run_stream(stream, str(tmp_path / "check"), handle)
    leads, log = RunTable(spark, f"{root}/leads", model.LEADS), MappingLog(spark, f"{root}/mappings")
    assert {r.run: r["count"] for r in leads.read().groupBy("run").count().collect()} == {
        "000000000000": 10, "000000000001": 15,
    }
    assert leads.read().filter("phone_e164 is null").isEmpty()
    assert log.current()["facebook"]["applicant_name"] == "split_full_name"
    # the second micro-batch once more: it starts from the mapping before it
    before = RunTable(spark, f"{root}/heal_events", model.HEAL_EVENTS).read().count()
    second = spark.read.text(str(inbox / "b.jsonl")).select(
        F.lit("facebook").alias("source"), F.col("value").alias("raw_line")
    )
    handle(second, 1)
    events = RunTable(spark, f"{root}/heal_events", model.HEAL_EVENTS).read()
    assert leads.read().count() == 25 and events.count() == before
    assert sorted(r.event for r in events.collect()) == ["drift_detected", "healed", "retry"]
