"""Readers: shapes of lines and files."""

import json

from pyspark.sql import functions as F

from contactlake import vocab
from contactlake.operators import records
from contactlake.operators.projection import canonicalize, split_valid
from contactlake.sources import feeds


def parse(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    return [r.rec for r in records.parse_lines(df).orderBy("i").select("rec").collect()]


def webhook(value):
    return json.dumps({"entry": [{"id": "1", "changes": [{"value": value}]}], "object": "page"})


def test_flat_lines(spark):
    got = parse(spark, ['{"a":1,"b":null,"c":true}', "   ", '{"a":1,"a":2}', "{}", '{"a":', "[1]", "{'a':1}"])
    assert got == [{"a": "1", "b": None, "c": "true"}, {"a": "2"}, {}, None, None, None]


def test_webhook_lines(spark):
    items = [
        {"name": "x", "values": ["1", "2"]},
        {"values": ["no name"]},
        {"name": "empty", "values": []},
        {"name": "gone"},
        {"name": "x", "values": ["last"]},
        {"name": "campaign_id", "values": ["over"]},
    ]
    got = parse(spark, [
        webhook({"campaign_id": "c", "created_time": None, "field_data": items}),
        webhook({}),
        '{"entry":[]}',
        '{"entry":null}',
        json.dumps({"entry": [{"changes": [{"field": "leadgen"}]}]}),
    ])
    assert got[0] == {
        "campaign_id": "over", "created_time": None, "x": "last", "": "no name", "empty": None, "gone": None,
    }
    assert got[1:] == [{}, None, None, None]


def test_all_changes_keeps_every_line(spark):
    two = json.dumps({"entry": [
        {"changes": [{"value": {"campaign_id": "a"}}, {"value": {"campaign_id": "b"}}]},
        {"changes": [{"value": {"campaign_id": "c"}}]},
    ]})
    df = spark.createDataFrame([(0, two), (1, '{"entry":[]}'), (2, '{"k":1}'), (3, "junk")], "i int, value string")
    got = sorted(
        (r.i, str(r.rec)) for r in records.flatten_all_changes(df).select("i", "rec").collect()
    )
    assert [g[0] for g in got] == [0, 0, 0, 1, 2, 3]
    assert got[3][1] == "None" and got[4][1] == "{'k': '1'}" and got[5][1] == "None"


def test_rename_webhook(spark):
    line = webhook({"field_data": [{"name": "phone_number", "values": ["phone_number"]}, {"name": "email", "values": ["e"]}]})
    df = spark.createDataFrame([(line,)], "value string")
    renamed = df.select(records.rename_webhook_fields(F.col("value"), vocab.DRIFT_RENAMES).alias("value"))
    got = records.with_record(renamed, "value").first().rec
    assert got == {"contact_phone": "phone_number", "email": "e"}


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Full Name,Phone #,Consent?\n"Ann\nLee","1 ""x""",Yes\n"Bo, C",,\n')
    rows = feeds.read_leads(spark, str(path), "instagram").orderBy("seq").collect()
    assert rows[0].rec == {"Full Name": "Ann\nLee", "Phone #": '1 "x"', "Consent?": "Yes"}
    assert rows[1].rec["Full Name"] == "Bo, C" and not rows[1].rec["Phone #"]


def test_csv_row_with_surplus_fields_goes_to_review(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("Full Name,E-mail\nAnn Lee,a@b.co\nBo,b@c.co,what,is,this\n")
    df = feeds.read_leads(spark, str(path), "instagram")
    mapping = {"instagram": {"Full Name": "split_full_name", "E-mail": "email"}}
    ok, failed = split_valid(canonicalize(df, mapping, F.lit("2026-01-01").cast("timestamp")))
    assert ok.select("email").first()[0] == "a@b.co"
    row = failed.first()
    assert list(row.violations) == ["unreadable_record"] and "what" in row.raw_line


def test_reading_a_folder_of_feeds(spark, tmp_path):
    (tmp_path / "landing_page.jsonl").write_text('{"fname":"A","mobile":null}\n\n{"fname":"B"}\n')
    (tmp_path / "google_form.csv").write_text("Timestamp,What's your name?\n08-Jul-2026,Ann\n")
    df = feeds.read_all(spark, str(tmp_path), vocab.FEED_FILES)
    assert {r.source: r["count"] for r in df.groupBy("source").count().collect()} == {
        "landing_page": 2, "google_form": 1,
    }
    only = feeds.read_all(spark, str(tmp_path), vocab.FEED_FILES, ["google_form"])
    assert only.count() == 1
    payloads = [json.loads(r.raw_payload) for r in df.filter("source = 'landing_page'").orderBy("seq").collect()]
    assert payloads == [{"fname": "A", "mobile": None}, {"fname": "B"}]


def test_landed_feed_prunes_by_source(spark, tmp_path):
    (tmp_path / "landing_page.jsonl").write_text('{"fname":"A"}\n')
    (tmp_path / "google_form.csv").write_text("Timestamp\n08-Jul-2026\n")
    landed = feeds.land(feeds.read_all(spark, str(tmp_path), vocab.FEED_FILES), str(tmp_path / "landed"))
    plan = landed.filter("source = 'google_form'").select("seq")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "ReadSchema: struct<seq:bigint>" in plan
