"""The leads table: only touched pieces are written again."""

import os

from pyspark.sql import functions as F

from contactlake import model
from contactlake.sources.tables import LeadsTable


def leads(spark, ids, campaign, day=1, status="clean"):
    rows = [(f"id-{i}", campaign, status) for i in ids]
    df = spark.createDataFrame(rows, "lead_id string, campaign_id string, status string")
    return model.conform(df.withColumn("ingested_at", F.lit(f"2026-08-{day:02}").cast("timestamp")), model.LEADS)


def contents(table):
    return {r.lead_id: (r.campaign_id, r.status) for r in table.read().collect()}


def test_insert_rewrites_only_pieces_with_replaced_ids(spark, tmp_path):
    table = LeadsTable(spark, str(tmp_path / "leads"), buckets=8)
    table.insert(leads(spark, range(400), "a"))
    first = {p.folder for p in table.pieces()}
    assert len(first) == 8
    # new ids only: every old piece stays
    table.insert(leads(spark, range(400, 440), "b", 2))
    second = {p.folder for p in table.pieces()}
    assert first < second
    # one replaced id: one old piece is written again, and one is added
    table.insert(leads(spark, [7], "c", 3))
    third = {p.folder for p in table.pieces()}
    assert len(second - third) == 1 and len(third - second) == 2
    got = contents(table)
    assert len(got) == 440 and got["id-7"][0] == "c" and got["id-8"][0] == "a" and got["id-401"][0] == "b"


def test_marking_touches_only_changed_rows_pieces(spark, tmp_path):
    table = LeadsTable(spark, str(tmp_path / "leads"), buckets=8)
    table.insert(leads(spark, range(200), "a"))
    before = {p.folder for p in table.pieces()}
    ids = spark.createDataFrame([("id-3",), ("id-3",), ("nobody",)], "lead_id string")
    table.mark(ids)
    after = {p.folder for p in table.pieces()}
    assert len(before - after) == 1 == len(after - before)
    table.mark(ids)  # they have it already
    assert {p.folder for p in table.pieces()} == after
    got = contents(table)
    assert len(got) == 200 and [i for i, (_, s) in got.items() if s == "duplicate"] == ["id-3"]


def test_old_versions_are_deleted_and_crowded_buckets_joined(spark, tmp_path):
    table = LeadsTable(spark, str(tmp_path / "leads"), buckets=1)
    for day in range(1, 13):
        table.insert(leads(spark, [day, 100], f"c{day}", day))
    listed = {p.folder for p in table.pieces()}
    assert len(table.pieces()) <= LeadsTable.MAX_PIECES
    kept = {f"{d}/{b}" for d in os.listdir(tmp_path / "leads/data") for b in os.listdir(tmp_path / "leads/data" / d) if "=" in b}
    assert listed <= kept and len(os.listdir(tmp_path / "leads/manifest")) == LeadsTable.KEEP_VERSIONS
    assert len(kept) < 20 and len(contents(table)) == 13 and contents(table)["id-100"][0] == "c12"


def test_empty_tables(spark, tmp_path):
    table = LeadsTable(spark, str(tmp_path / "leads"))
    assert table.read().isEmpty()
    assert table.mark(spark.createDataFrame([("x",)], "lead_id string")).isEmpty()
    table.insert(leads(spark, [], "a"))
    assert table.read().isEmpty()
    table.insert(leads(spark, [1], "a"))
    table.insert(leads(spark, [], "b"))
    assert contents(table) == {"id-1": ("a", "clean")}


def test_rows_are_shuffled_once_a_write(spark, tmp_path, monkeypatch):
    plans, write = [], LeadsTable._write

    def watched(self, rows, *others):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows, *others)

    monkeypatch.setattr(LeadsTable, "_write", watched)
    table = LeadsTable(spark, str(tmp_path / "leads"), buckets=2)
    table.insert(leads(spark, range(100), "a"))
    new = leads(spark, [7, 8], "b", 2)
    table.insert(new.unionByName(leads(spark, [7], "c", 3)))
    got = {r.lead_id: r.campaign_id for r in table.read().collect()}
    assert len(got) == 100 and sorted(got.values())[-2:] == ["b", "c"]
    for plan in (plans[0], plans[1]):
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(bucket" in plan
