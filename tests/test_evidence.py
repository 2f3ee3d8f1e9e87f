"""Mapping inference judges a field by all of its values, not by the first few."""

from pyspark.sql import functions as F

from contactlake.operators import inference
from contactlake.operators.profiling import profile_source
from contactlake.plans import healing
from tests.test_healing import frame


def _late(i: int) -> dict:
    junk = i < 4
    return {
        "full_name": f"Ann Lee{'abcdefghij'[i % 10]}", "email": "n/a" if junk else f"ann{i}@acme.com",
        "phone": "tbd" if junk else f"+1212555{1000 + i}", "created": "2026-07-16",
    }


def test_junk_in_the_first_values_does_not_hide_a_field(spark):
    profile = profile_source(frame(spark, {"facebook": [_late(i) for i in range(40)]}))
    got = {r.field: r.transform for r in inference.infer_mapping(profile).collect()}
    assert (got["email"], got["phone"]) == ("email", "phone")
    seen = {r.field: r.evidence for r in profile.collect()}
    assert seen["email"]["values"] == 40 and abs(seen["email"]["email"] - 0.9) < 1e-9


def test_good_first_values_do_not_hide_junk(spark):
    recs = [{"email": f"ann{i}@acme.com" if i < 4 else "n/a", "none": ""} for i in range(40)]
    profile = profile_source(frame(spark, {"facebook": recs}))
    got = {r.field: r.transform for r in inference.infer_mapping(profile).collect()}
    assert got["email"] == "ignore"
    assert {r.field: r.evidence for r in profile.collect()}["none"] is None


def test_healing_learns_behind_junk(spark):
    rows = frame(spark, {"facebook": [_late(i) for i in range(40)]})
    healed = healing.heal(rows, {}, F.lit("2026-08-01").cast("timestamp"))
    assert healed.mappings["facebook"]["email"] == "email"
