"""Positions and places without moving rows, and ids that survive."""

import json

from pyspark.sql import functions as F

from contactlake import vocab
from contactlake.operators.positions import form_batches, landed_position, number_sorted, numbered_runs, with_position
from contactlake.operators.projection import canonicalize
from contactlake.session import Scratch
from contactlake.sources import feeds


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def landed(spark, rows):
    df = spark.createDataFrame(rows, "source string, seq bigint").repartitionByRange(5, "seq")
    return Scratch(spark, "t").put("landed", numbered_runs(df.sortWithinPartitions("source", "seq")))


def test_landed_positions_equal_the_others_without_an_exchange(spark):
    df = landed(spark, [("abc"[i % 3], i * 7) for i in range(500)])
    got = landed_position(df, ["source"])
    assert not exchanges(got) and not exchanges(form_batches(df, 10, place=landed_position))
    want = with_position(df, ["source"])
    key = lambda r: (r.source, r.seq, r.pos)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_overlapping_runs_are_numbered_by_the_order_column(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "source string, seq bigint").repartition(4)
    df = Scratch(spark, "t").put("mixed", numbered_runs(df.sortWithinPartitions("source", "seq")))
    assert {(r.seq, r.pos) for r in landed_position(df, ["source"]).collect()} == {(i, i) for i in range(100)}


def test_places_in_a_total_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k int, v string").repartition(7)
    got = number_sorted(df, [F.desc("k")], Scratch(spark, "t"))
    assert {(r.k, r.pos) for r in got.collect()} == {(i, 100 - i) for i in range(101)}


def line(i):
    return json.dumps({"fname": "Ann", "email_addr": f"a{i}@acme.com", "submitted_at": "2026-07-05"})


def ids(spark, folder, split=None):
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        scratch = Scratch(spark, "t")
        rows = feeds.land(feeds.read_leads(spark, str(folder), "landing_page", "jsonl"), scratch.path("landed"))
        placed = feeds.with_places(rows, scratch)
        assert not exchanges(placed)
        checked = canonicalize(placed, vocab.KNOWN_MAPPINGS, F.lit("2026-08-01").cast("timestamp"), identity=feeds.IDENTITY)
        return sorted((r.lead_id, r.email) for r in checked.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_survive_new_files_other_splits_and_growth(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join([line(1), "", line(2), line(1), "  ", line(1)] + [line(i) for i in range(200)]))
    first = ids(spark, tmp_path)
    assert len(first) == len({i for i, _ in first}) == 204  # equal lines keep ids of their own
    assert ids(spark, tmp_path, split=500) == first
    (tmp_path / "a.jsonl").write_text("\n".join(line(i) for i in range(10)))
    with (tmp_path / "b.jsonl").open("a") as file:
        file.write("\n" + line(999))
    again = ids(spark, tmp_path)
    assert set(first) < set(again) and len(again) == 215


def test_places_of_csv_rows(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / f"{name}.csv").write_text("a,b\n" + "".join(f"{name}{i},\"v, {i}\"\n" for i in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        scratch = Scratch(spark, "t")
        rows = feeds.land(feeds.read_leads(spark, str(tmp_path), "form", "csv"), scratch.path("landed"))
        got = {(r.file, r.place, r.rec["a"]) for r in feeds.with_places(rows, scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"{n}.csv", i, f"{n}{i}") for n in "xy" for i in range(50)}
