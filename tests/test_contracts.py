"""Results that once were wrong: own sources, repeated runs, short rows, names by structure, ties, scratch folders."""

import json
import time

import pytest
from pyspark.sql import functions as F

from contactlake.functions import dates, phones, similarity
from contactlake.functions.layers import apply_layers
from contactlake.operators import records
from contactlake.operators.upsert import latest_by_key, upsert
from contactlake.plans.ingest import Tables, run_ingest
from contactlake.session import scratch_root
from contactlake.sources import feeds

def now():
    return F.lit("2026-08-01").cast("timestamp")


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_own_sources_and_repeated_runs(spark, tmp_path):
    people = [
        {"Full Name": f"Ann{chr(97 + i)} Lee{chr(97 + i)}", "E-mail": f"ann{i}@vexcorp.net", "Phone": f"212-555-{1000 + i}", "Date": "2026-07-04"}
        for i in range(20)
    ]
    renamed = [{"Applicant Name": p["Full Name"], "Mail address": p["E-mail"], "Mobile": p["Phone"], "Date": p["Date"]} for p in people]
    lines(tmp_path / "partner.jsonl", people + renamed)
    root, files = str(tmp_path / "lake"), {"partner": "partner.jsonl"}
    seen = []
    for _ in range(2):
        run_ingest(spark, str(tmp_path), root, "1", now(), files=files, batch_size=10)
        tables = Tables.under(spark, root)
        log = tables.mappings.read().orderBy("version", "ordinal").collect()
        seen.append((sorted(r.event for r in tables.heal_events.read().collect()), log, tables.leads.read().count()))
        assert tables.review_queue.read().isEmpty()
    assert seen[0] == seen[1] and seen[0][2] == 40
    assert seen[0][0] == ["drift_detected", "healed", "mapping_learned", "retry"]
    assert Tables.under(spark, root).mappings.read(before_run="10").count() == len(seen[0][1])


def test_short_csv_rows_are_ingested(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,mail,tel\nBob Roy,b@c.com\n"Ann, B",x@y.z,1\n"a,b","c,d",e,f\nz,,\n')
    rows = feeds.read_leads(spark, str(tmp_path / "a.csv"), "own").collect()
    assert [r.rec for r in rows] == [
        {"name": "Bob Roy", "mail": "b@c.com", "tel": None}, {"name": "Ann, B", "mail": "x@y.z", "tel": "1"}, None,
        {"name": "z", "mail": None, "tel": None},
    ]
    assert rows[2].raw_line == '"a,b","c,d",e,f'


def test_blank_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\t \t\n  \n{"a":1}\n')
    assert [r.rec for r in feeds.read_leads(spark, str(tmp_path / "a.jsonl"), "own").collect()] == [{"a": "1"}]


def test_rename_touches_the_first_change_only(spark):
    odd = [{"name": "full_name", "values": ['"name":"full_name"']}, {"name": "q$?(x", "values": []}]
    other = {"value": {"field_data": [{"name": "full_name"}]}}
    given = [{"entry": [{"changes": [{"value": {"field_data": odd}}, other]}]}, {"entry": [{"changes": [{"value": {}}, other]}]}]
    frame = spark.createDataFrame([(json.dumps(g),) for g in given], "line string")
    renames = {"full_name": "applicant_name", "q$?(x": "new$1\\"}
    first, second = (json.loads(r[0]) for r in frame.select(records.rename_webhook_fields(F.col("line"), renames)).collect())
    assert [i["name"] for i in first["entry"][0]["changes"][0]["value"]["field_data"]] == ["applicant_name", "new$1\\"]
    assert first["entry"][0]["changes"][0]["value"]["field_data"][0]["values"] == odd[0]["values"]
    assert first["entry"][0]["changes"][1] == other and second == given[1]


def test_upsert_ties(spark):
    old = spark.createDataFrame([("a", 0, "old"), ("b", 0, "old")], "id string, at int, v string")
    new = spark.createDataFrame([("a", 1, "y", 1), ("a", 1, "x", 2), ("c", 1, "z", 3)], "id string, at int, v string, seq int")
    rows = {r.id: r.v for r in upsert(old, new, "id", ("at", "seq")).collect()}
    assert rows == {"a": "x", "b": "old", "c": "z"}
    assert latest_by_key(new.drop("seq"), "id", "at").filter("id = 'a'").head().v == "y"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())


DATES = {
    "07/16/26": "2026-07-16 00:00:00", "Jul 16 26": "2026-07-16 00:00:00", "16 Jul 98": "1998-07-16 00:00:00",
    "07/16/2026 10:30 PM UTC": "2026-07-16 22:30:00", "2026-07-16 10:30 EST": "2026-07-16 10:30:00",
    "Thu Jul 16 10:30:00 2026": "2026-07-16 10:30:00", "Thu Jul 16 10:30:00 UTC 2026": "2026-07-16 10:30:00",
    "July 16, 2026 at 10:30 AM": "2026-07-16 10:30:00", "10:30 2026-07-16": "2026-07-16 10:30:00",
    "10:30 PM, Jul 16 2026": "2026-07-16 22:30:00", "07/16/2026 10:30 PM -0500": "2026-07-17 03:30:00",
    " " * 90 + "2026-07-04": "2026-07-04 00:00:00", "July": None, "10": None, "07/16/2": None,
}
PHONES = {
    "+0123456789": (None, "phone_unparseable"), "+9991234567": (None, "phone_unparseable"),
    "+442071838750": ("+442071838750", None), "+35312345678": ("+35312345678", None),
    "0123456789": ("+10123456789", None), " " * 300 + "212 555 1000": ("+12125551000", None),
    "2125551000" + "." * 250: (None, "phone_unparseable"),
}


def test_dates_of_many_styles(spark):
    frame = spark.createDataFrame([(d,) for d in DATES], "d string")
    rows = apply_layers(frame, dates.date_recipe(F.col("d"), "o")).select("d", F.col("o").cast("string").alias("o")).collect()
    assert {r.d: r.o for r in rows} == DATES
    early = apply_layers(frame, dates.date_recipe(F.col("d"), "o", pivot=20)).filter("d = '07/16/26'")
    assert early.select(F.year("o")).head()[0] == 1926


def test_phone_codes(spark):
    frame = spark.createDataFrame([(p,) for p in PHONES], "p string")
    rows = apply_layers(frame, phones.phone_recipe(F.col("p"), "o")).collect()
    assert {r.p: (r.o, r.o_flag) for r in rows} == PHONES


def test_similarity_of_long_names(spark):
    a, b = ("abcde fgh" * 250)[:2000], ("bcdx fghi" * 250)[:2000]
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    began = time.monotonic()
    assert frame.select(similarity.lcs_length(F.col("a"), F.col("b"))).head()[0] == row[-1]
    assert time.monotonic() - began < 20
