"""Mapping, flags, contract, ids; positions and batches."""

import random

from pyspark.sql import functions as F

from contactlake import vocab
from contactlake.operators.positions import first_per_group, form_batches, slice_records, with_position
from contactlake.operators.projection import canonicalize, check_contract, split_valid, with_occurrence

SCHEMA = "source string, seq bigint, raw_line string, rec map<string,string>"
TS = "2026-08-01 00:00:00"


def leads(spark, recs, mapping, source="facebook"):
    rows = [(source, i, str(i), rec) for i, rec in enumerate(recs)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = canonicalize(df, {source: mapping}, F.lit(TS).cast("timestamp"), keep=("seq",))
    return out.orderBy("seq").collect()


FULL = {
    "name": "Ann Lee", "mail": "ann@acme.com", "tel": "6889373467", "c": "x", "when": "2026-07-05", "ok": "yes",
}
MAP = {
    "name": "split_full_name", "mail": "email", "tel": "phone", "c": "campaign_id", "when": "created_at", "ok": "consent",
}


def test_complete_row(spark):
    (row,) = leads(spark, [FULL], MAP)
    assert (row.first_name, row.last_name, row.email, row.phone_e164) == ("Ann", "Lee", "ann@acme.com", "+16889373467")
    assert (row.quality_score, row.status, row.flags, row.violations) == (100, "clean", [], [])


def test_flags_follow_the_mapping_order(spark):
    bad = {"name": "", "mail": "", "tel": "12345", "when": "junk"}
    (a,) = leads(spark, [bad], MAP)
    (b,) = leads(spark, [bad], {"tel": "phone", "mail": "email", "when": "created_at"})
    assert a.flags == ["email_missing", "phone_junk", "date_missing", "name_missing"]
    assert b.flags == ["phone_junk", "email_missing", "date_missing", "name_missing"]
    assert a.status == b.status == "flagged" and str(a.created_at).startswith("2026-08-0")


def test_unmapped_targets_set_no_flags(spark):
    (row,) = leads(spark, [{"name": "Ann Lee", "when": "2026-07-05"}], {"name": "split_full_name", "when": "created_at"})
    assert row.flags == [] and row.status == "clean" and row.email is None


def test_last_field_of_a_target_wins_even_when_null(spark):
    mapping = {**MAP, "mail2": "email", "tel2": "phone", "nick": "first_name"}
    rec = {**FULL, "mail2": "asdf@asdf", "tel2": None, "nick": None}
    (row,) = leads(spark, [rec], mapping)
    assert row.email is None and row.phone_e164 is None
    assert row.first_name is None and row.last_name == "Lee"
    assert row.flags == ["email_invalid", "phone_missing"]


def test_routes_with_different_numbers_of_fields(spark):
    rows = [("facebook", 0, "a", FULL), ("instagram", 1, "b", {"m1": "kim@gmial.com", "m2": "b@acme.com", "n": "Bo C"})]
    df = spark.createDataFrame(rows, SCHEMA)
    mappings = {"facebook": MAP, "instagram": {"m1": "email", "m2": "email", "n": "split_full_name"}}
    got = canonicalize(df, mappings, F.lit(TS).cast("timestamp"), keep=("seq",)).orderBy("seq").collect()
    assert got[0].email == "ann@acme.com" and got[0].flags == []
    assert got[1].email == "b@acme.com"
    assert got[1].flags == ["email_typo_domain:gmial.com", "date_missing"]


def test_failures(spark):
    late = {**FULL, "when": "253402300800"}
    assert leads(spark, [late], MAP)[0].violations == ["created_at_range"]
    assert leads(spark, [FULL], {**MAP, "c": "shout"})[0].violations == ["unknown_transform:shout"]
    assert leads(spark, [None], MAP)[0].violations == ["unreadable_record"]
    assert leads(spark, [FULL], MAP, "fax")[0].violations == ["source_unknown"]


def test_rows_are_kept_whole(spark):
    rng = random.Random(1)
    recs = [
        None if rng.random() < 0.1 else {k: v for k, v in FULL.items() if rng.random() < 0.8}
        for _ in range(300)
    ]
    rows = [("facebook", i, str(i), rec) for i, rec in enumerate(recs)]
    out = canonicalize(spark.createDataFrame(rows, SCHEMA), {"facebook": MAP}, F.lit(TS).cast("timestamp"), keep=("seq",))
    ok, failed = split_valid(out)
    assert ok.count() + failed.count() == 300 and failed.count() == sum(r is None for r in recs)
    scores = [r.quality_score for r in ok.select("quality_score").collect()]
    assert min(scores) >= 0 and max(scores) <= 100
    assert check_contract(ok).filter("size(violations) > 0").isEmpty()
    assert ok.select("lead_id").distinct().count() == ok.count()


def test_filters_stay_above_the_cleaning(spark):
    df = spark.createDataFrame([("facebook", 0, "a", FULL)], SCHEMA)
    out = canonicalize(df, {"facebook": MAP}, F.lit(TS).cast("timestamp")).filter("status = 'clean' and email is not null")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "Exchange"):
        assert node not in plan
    assert out.count() == 1


def test_positions_of_sparse_sequences(spark):
    rng = random.Random(2)
    seqs = {s: sorted(rng.sample(range(0, 1 << 40), 400)) for s in "ab"}
    seqs["a"] += [(5 << 33) + i for i in range(300)]
    rows = [(s, q) for s, qs in seqs.items() for q in set(qs)]
    rng.shuffle(rows)
    got = with_position(spark.createDataFrame(rows, "source string, seq bigint"), ["source"]).collect()
    for s in "ab":
        order = sorted({q for k, q in rows if k == s})
        assert {r.seq: r.pos for r in got if r.source == s} == {q: i for i, q in enumerate(order)}


def test_slices_and_batches(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(3)], "source string, seq bigint")
    cut = slice_records(df, skip=2, limit=5)
    assert sorted((r.source, r.seq) for r in cut.collect()) == [("a", i) for i in range(2, 7)] + [("b", 2)]
    sizes = form_batches(df, 10).groupBy("source", "batch_id").count().collect()
    assert sorted(tuple(r) for r in sizes) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 3)]


def test_first_rows_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", 7)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(16)
    got = first_per_group(df, ["k"], ["v"], 4, lanes=3).collect()
    assert sorted(tuple(r) for r in got) == [("cold", 7), ("hot", 0), ("hot", 1), ("hot", 2), ("hot", 3)]
    plan = first_per_group(df, ["k"], ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_occurrence_numbers(spark):
    rows = [("s", i, "same" if i % 3 else f"line {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, seq bigint, raw_line string")
    got = with_occurrence(df).filter("raw_line = 'same'").orderBy("seq").collect()
    assert [r.occurrence_no for r in got] == list(range(2000))


def test_known_mappings_use_known_transforms():
    for mapping in vocab.KNOWN_MAPPINGS.values():
        assert set(mapping.values()) <= set(vocab.TRANSFORMS)
