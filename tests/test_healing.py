"""Drift boundaries, mapping validation and the event sequences of healing."""

from pyspark.sql import functions as F

from contactlake import vocab
from contactlake.operators import drift, inference, mappings as M
from contactlake.operators.positions import form_batches
from contactlake.operators.profiling import profile_source
from contactlake.plans import healing

SCHEMA = "source string, seq bigint, raw_line string, rec map<string,string>"
MAP = {"name": "split_full_name", "mail": "email", "note": "ignore", "when": "created_at"}
GOOD = {"name": "Ann Lee", "mail": "ann@acme.com", "when": "2026-07-05"}


def frame(spark, recs_by_source, size=10):
    rows = [
        (source, i, f"{source} {i}", rec)
        for source, recs in recs_by_source.items()
        for i, rec in enumerate(recs)
    ]
    return form_batches(spark.createDataFrame(rows, SCHEMA), size)


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


def test_drift_boundaries(spark):
    late = {**GOOD, "when": "253402300800"}
    cases = {
        "facebook": ([without("mail")] * 8 + [GOOD] * 2, False),  # 0.8 is not over 0.8
        "instagram": ([without("mail")] * 9 + [GOOD], True),
        "google_form": ([late] * 5 + [GOOD] * 5, False),  # 0.5 is not over 0.5
        "landing_page": ([late] * 6 + [GOOD] * 4, True),
    }
    df = frame(spark, {s: recs for s, (recs, _) in cases.items()})
    got = {r.source: r for r in drift.batch_health(df, {s: MAP for s in cases}).collect()}
    assert {s: got[s].drifted for s in cases} == {s: want for s, (_, want) in cases.items()}
    assert got["instagram"].missing["mail"] == 9 and got["landing_page"].failed == 6
    assert "note" not in got["facebook"].missing  # ignored fields are not counted


def test_null_values_are_present(spark):
    df = frame(spark, {"facebook": [{"name": None, "mail": None, "when": None}] * 10})
    (row,) = drift.batch_health(df, {"facebook": MAP}).collect()
    assert not row.drifted and set(row.missing.values()) == {0}


def test_empty_batch_gives_no_rows(spark):
    assert drift.batch_health(frame(spark, {"facebook": []}), {"facebook": MAP}).isEmpty()


def test_report(spark):
    recs = [{"nom": "Ann", "when": "253402300800"}] * 7 + [{"nom": "Bo", "extra": "x"}] * 3
    (row,) = drift.drift_report(frame(spark, {"facebook": recs}), {"facebook": MAP}).collect()
    assert (row.n, row.failed, sorted(row.dead_fields)) == (10, 7, ["mail", "name"])
    assert row.unmapped == ["extra", "nom"] and row.first_keys == ["nom", "when"]
    assert row.errors == ["created_at_range"] * 5
    assert "batch size: 10, failing rows: 7" in row.report


def test_fast_failure_test_equals_the_projection(spark):
    from contactlake.operators.projection import canonicalize

    recs = [GOOD, {**GOOD, "when": "253402300800"}, {**GOOD, "when": "999999999999"}, {**GOOD, "when": "1000000000001"}, {}]
    df = frame(spark, {"facebook": recs, "fax": [GOOD]})
    maps = {"facebook": MAP, "fax": MAP}
    full = canonicalize(df, maps, F.lit("2026-01-01").cast("timestamp"), keep=("seq",))
    fast = df.select("source", "seq", drift.record_error(maps, "source", vocab.SOURCES).alias("e"))
    a = {(r.source, r.seq): r.violations for r in full.collect()}
    b = {(r.source, r.seq): [r.e] if r.e else [] for r in fast.collect()}
    assert a == b and sum(map(len, a.values())) == 3


def test_profile_counts_presence_and_cuts_samples(spark):
    recs = [{"a": ""}, {"a": "x" * 100, "b": None}] + [{"a": str(i)} for i in range(600)]
    rows = {r.field: r for r in profile_source(frame(spark, {"facebook": recs})).collect()}
    assert rows["a"].n == rows["a"].present and rows["a"].fill_rate == 1.0 and rows["b"].present == 1
    assert rows["a"].samples == ["x" * 100, "0", "1", "2"] and rows["b"].samples == []
    cut = {r.field: r for r in profile_source(frame(spark, {"facebook": recs}), max_rows=500, width=60).collect()}
    assert cut["a"].n == 500 and cut["a"].samples[0] == "x" * 60


def sparse_mapping(key):
    """Valid, but on fields that hardly ever occur: it drifts."""
    return [(*key, 1, "rare_name", "split_full_name"), (*key, 2, "rare_mail", "email")]


def right_mapping(key):
    return [(*key, 1, "nom", "split_full_name"), (*key, 2, "post", "email"), (*key, 3, "day", "created_at")]


class Scripted:
    """A mapper with a list of answers per source, batch and mode, for its attempts in order; else it is wrong."""

    def __init__(self, spark, answers):
        self.spark, self.answers = spark, answers

    def __call__(self, profile, memory, attempt, feedback, keys):
        rows = []
        for key in profile.select(*keys).distinct().collect():
            given = self.answers.get(tuple(key), [])
            rows += {
                "right": right_mapping, "sparse": sparse_mapping,
                "wrong": lambda k: [(*k, 1, "no_such_field", "email")],
            }[given[attempt - 1] if attempt <= len(given) else "wrong"](key)
        return self.spark.createDataFrame(
            rows, "source string, batch_id bigint, mode string, ordinal int, field string, transform string"
        )


def changed(i):
    rec = {"nom": "Ann Lee", "post": f"a{i}@acme.com", "day": "2026-07-05"}
    return {**rec, "rare_name": "Ann", "rare_mail": "r@acme.com"} if i == 0 else rec


def sequence(healed, source):
    rows = healed.events.filter(F.col("source") == source).orderBy("batch_id", "step").collect()
    return [(e.batch_id, e.event, e.attempt) for e in rows]


def test_event_sequences(spark):
    drifting = [GOOD] * 20 + [changed(i % 10) for i in range(20)]
    df = frame(spark, {s: drifting for s in vocab.SOURCES})
    mapper = Scripted(spark, {
        ("facebook", 2, "heal"): ["right"],
        ("instagram", 2, "heal"): ["sparse", "sparse", "right"],
        # given up at batch 2, then a cold start at batch 3 that is accepted
        ("google_form", 2, "heal"): ["sparse", "sparse", "sparse"],
        ("google_form", 3, "cold"): ["right"],
        # every inference is rejected: both batches end in review
    })
    healed = healing.heal(df, {s: MAP for s in vocab.SOURCES}, F.lit("2026-08-01").cast("timestamp"), mapper)
    drift_, retry = (2, "drift_detected", 0), [(2, "retry", i) for i in (1, 2, 3)]
    assert sequence(healed, "facebook") == [drift_, retry[0], (2, "healed", 1)]
    assert sequence(healed, "instagram") == [drift_, *retry, (2, "healed", 3)]
    assert sequence(healed, "google_form") == [drift_, *retry, (2, "human_review", 0), (3, "mapping_learned", 0)]
    assert sequence(healed, "landing_page") == [drift_, *retry, (2, "human_review", 0), (3, "human_review", 0)]
    leads = {r.source: r["count"] for r in healed.leads.groupBy("source").count().collect()}
    review = {r.source: r["count"] for r in healed.review.groupBy("source").count().collect()}
    assert leads == {"facebook": 40, "instagram": 40, "google_form": 30, "landing_page": 20}
    assert review == {"google_form": 10, "landing_page": 20}
    assert healed.mappings["landing_page"] is None
    assert healed.leads.filter("status = 'flagged'").isEmpty()


def test_cold_starts(spark):
    new = [changed(i % 10) for i in range(10)]
    df = frame(spark, {"facebook": new, "instagram": new, "google_form": new, "landing_page": [GOOD] * 10})
    mapper = Scripted(spark, {
        ("facebook", 0, "cold"): ["right"], ("instagram", 0, "cold"): ["sparse"], ("instagram", 0, "heal"): ["right"],
    })
    healed = healing.heal(df, {"landing_page": MAP}, F.lit("2026-08-01").cast("timestamp"), mapper)
    assert sequence(healed, "facebook") == [(0, "mapping_learned", 0)]
    assert sequence(healed, "instagram") == [
        (0, "mapping_learned", 0), (0, "drift_detected", 0), (0, "retry", 1), (0, "healed", 1),
    ]
    assert sequence(healed, "google_form") == [(0, "human_review", 0)]
    assert sequence(healed, "landing_page") == []


def test_unreadable_and_failed_rows_are_queued(spark):
    recs = [GOOD] * 8 + [None, {**GOOD, "when": "253402300800"}]
    healed = healing.heal(frame(spark, {"facebook": recs}), {"facebook": MAP}, F.lit("2026-08-01").cast("timestamp"))
    assert healed.leads.count() == 8
    reasons = sorted(r.reason for r in healed.review.collect())
    assert reasons == ["row validation failed: created_at_range", "unreadable record"]


def test_inference_lowers_its_demands(spark):
    recs = [{"kontakt": "ann@acme.com", "wer": "Ann Lee", "fname": "Ann"}] * 5
    profile = profile_source(frame(spark, {"facebook": recs}))
    strict = {r.field: r.transform for r in inference.infer_mapping(profile).collect()}
    loose = {r.field: r.transform for r in inference.infer_mapping(profile, attempt=3).collect()}
    assert strict["kontakt"] == "ignore" and loose["kontakt"] == "email"
    assert strict["fname"] == loose["fname"] == "first_name"


def test_memory_helps_inference(spark):
    recs = [{"kontakt": "ann@acme.com", "fname": "Ann"}] * 5
    profile = profile_source(frame(spark, {"facebook": recs}))
    memory = spark.createDataFrame([("kontakt", "email")], "field string, transform string")
    got = {r.field: r.transform for r in inference.infer_mapping(profile, memory, attempt=2).collect()}
    assert got["kontakt"] == "email"


def test_the_report_moves_no_records(spark):
    rows = [("facebook", i // 4, i % 4, i, {"nom" if i >= 4 else "full_name": "Ann", "email": "a@acme.com"}) for i in range(8)]
    batches = spark.createDataFrame(rows, "source string, batch_id bigint, batch_pos bigint, seq bigint, rec map<string,string>")
    report = drift.drift_report(batches, {"facebook": {"full_name": "split_full_name", "email": "email"}})
    (row,) = report.collect()
    assert (row.batch_id, row.unmapped, row.first_keys) == (1, ["nom"], ["email", "nom"])
    assert "LeftSemi" not in report._jdf.queryExecution().optimizedPlan().toString()
