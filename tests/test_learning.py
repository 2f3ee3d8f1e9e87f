"""Healing against a batch-by-batch run, and inference with memory, feedback and assignment."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contactlake import vocab
from contactlake.operators import drift, inference, memory
from contactlake.operators.profiling import profile_source
from contactlake.plans import healing
from tests.test_healing import GOOD, MAP, frame

NEW = {"nom": "Ann Lee", "post": "ann@acme.com", "day": "2026-07-05"}
NEW_MAP = {"nom": "split_full_name", "post": "email", "day": "created_at"}
OLD_MAP = {f: t for f, t in MAP.items() if f in GOOD}
LOST = {"x1": "?", "x2": "!"}
LAYOUTS = {"A": GOOD, "B": NEW, "C": LOST, "L": {**GOOD, "when": "253402300800"}}


def by_layout(profile, memory_, attempt, feedback, keys):
    """A mapper that knows two layouts."""
    fields = {"name": OLD_MAP, "nom": NEW_MAP}
    table = [(mark, i, f, t) for mark, m in fields.items() for i, (f, t) in enumerate(m.items(), 1)]
    known = profile.sparkSession.createDataFrame(table, "mark string, ordinal int, field string, transform string")
    return profile.select(*keys, F.col("field").alias("mark")).join(known, "mark").drop("mark")


by_layout.repeats = True


def in_order(layouts, mapping):
    """(batch, event, attempt) of a run that takes one batch after the other, and the layouts that end in review."""
    events, review = [], []
    for b, layout in enumerate(layouts):
        rec = LAYOUTS[layout]
        mine = OLD_MAP if "name" in rec else NEW_MAP if "nom" in rec else None
        fits = lambda m: not drift.judge(
            m, 4, {f: 4 for f in rec}, {"when": 4} if layout == "L" else {}
        ).drifted
        if mapping is None:
            if mine is None:
                events.append((b, "human_review", 0))
                review.append(b)
                continue
            mapping = mine
            events.append((b, "mapping_learned", 0))
        if not fits(mapping):
            events.append((b, "drift_detected", 0))
            for attempt in (1, 2, 3):
                events.append((b, "retry", attempt))
                if mine is not None and fits(mine):
                    mapping = mine
                    events.append((b, "healed", attempt))
                    break
            else:
                mapping = None
                events.append((b, "human_review", 0))
                review.append(b)
    return events, review


def run(spark, layouts, known):
    recs = [LAYOUTS[x] for x in layouts for _ in range(4)]
    return healing.heal(frame(spark, {"facebook": recs}, 4), known, F.lit("2026-08-01").cast("timestamp"), by_layout)


@pytest.mark.parametrize("layouts,known", [("ABACCBLLA", True), ("CCBA", False)])
def test_healing_equals_a_run_batch_by_batch(spark, layouts, known):
    healed = run(spark, layouts, {"facebook": MAP} if known else {})
    events, review = in_order(layouts, MAP if known else None)
    got = [(r.batch_id, r.event, r.attempt) for r in healed.events.orderBy("batch_id", "step").collect()]
    assert got == events
    leads = {r.batch_id: r["count"] for r in healed.leads.groupBy("batch_id").count().collect()}
    assert leads == {b: 4 for b in range(len(layouts)) if b not in review}
    assert healed.review.count() == 4 * len(review)


def jobs(spark, layouts, group):
    spark.sparkContext.setJobGroup(group, group)
    try:
        healed = run(spark, layouts, {"facebook": MAP})
        healed.leads.count(), healed.review.count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_the_batches(spark):
    """Three unmappable batches, or thirty and layouts that change with every batch."""
    few, many = jobs(spark, "ACCCAB", "few"), jobs(spark, "A" + "C" * 30 + "AB" * 8, "many")
    assert many <= few + 5  # adaptive plans differ by a job or two


def test_judge_equals_the_drift_test(spark):
    draw = random.Random(4)
    recs = {s: [] for s in vocab.SOURCES}
    for s in recs:
        for _ in range(12):
            shape = draw.choice([GOOD, {"name": "x"}, {**GOOD, "when": "253402300800"}, {"mail": None, "q": "1"}, {}])
            recs[s] += [shape if draw.random() < 0.7 else GOOD for _ in range(5)]
    df = frame(spark, recs, 5)
    want = {(r.source, r.batch_id): (r.n, sorted(r.dead_fields), r.failed, r.drifted) for r in drift.batch_health(df, {s: MAP for s in recs}).collect()}
    for r in drift.signatures(df).collect():
        present, late = {c.field: c.present for c in r.fields}, {c.field: c.late for c in r.fields}
        v = drift.judge(MAP, r.n, present, late)
        assert (r.n, sorted(v.dead), v.failed, v.drifted) == want.pop((r.source, r.batch_id))
    assert not want


def test_assignment_is_the_best_one_to_one_choice():
    draw = random.Random(6)
    transforms = list(inference.NAME_WORDS)
    for _ in range(40):
        edges = [(f"f{i}", t, draw.choice([0.3, 0.5, 0.55, 0.9])) for i in range(4) for t in draw.sample(transforms, draw.randint(0, 3))]
        got = inference.assign(edges)
        score = {(f, t): s for f, t, s in edges}
        options = [[None, *[t for g, t, _ in edges if g == f"f{i}"]] for i in range(4)]
        best = max(
            sum(score[f"f{i}", t] for i, t in enumerate(pick) if t)
            for pick in itertools.product(*options)
            if len([t for t in pick if t]) == len({t for t in pick if t})
        )
        assert abs(sum(score[p] for p in got) - best) < 1e-9
        assert len({f for f, _ in got}) == len(got) == len({t for _, t in got})


def test_assignment_keeps_both_where_a_greedy_choice_loses_one():
    got = inference.assign([("a", "email", 0.9), ("a", "phone", 0.56), ("b", "email", 0.85)])
    assert got == [("a", "phone"), ("b", "email")]


def test_failed_pairs_are_not_proposed_again(spark):
    recs = [{"email": f"a{i}@acme.com", "mail": f"b{i}@acme.com", "name": "Ann Lee"} for i in range(5)]
    profile = profile_source(frame(spark, {"facebook": recs}))
    told = spark.createDataFrame(
        [("facebook", "r", [("email", "email"), ("name", None)])],
        "source string, report string, failed array<struct<field:string,transform:string>>",
    )
    plain = {r.field: r.transform for r in inference.infer_mapping(profile).collect()}
    other = {r.field: r.transform for r in inference.infer_mapping(profile, None, 1, told).collect()}
    assert plain["name"] == "split_full_name" and "email" in (plain["email"], plain["mail"])
    assert other == {"email": "ignore", "mail": "email", "name": "ignore"}


def remembered(spark, n=400):
    words = "ana bel cor dun eis fal gor hul ist jon".split()
    rows = []
    for i in range(n):
        field = f"{words[i % 10]} {words[i // 10 % 10]}{'' if i % 3 else ' ' + words[i // 100]}"
        sample = [f"{words[(i * 7) % 10]}{i % 13}@x.com"] if i % 2 else [f"+1 212 {i % 50}", "n/a"]
        rows.append((f"s{i}::{field}", f"s{i}", field, "email" if i % 2 else "phone", sample))
    df = spark.createDataFrame(rows, "id string, source string, field string, transform string, samples array<string>")
    return df.withColumn("vector", memory.field_vector(F.col("field"), F.col("samples")))


def test_index_finds_what_the_exact_search_finds(spark):
    known = remembered(spark).cache()
    asked = known.filter(F.xxhash64("id") % 4 == 0).select(F.col("id").alias("asked"), "vector")
    exact = memory.similar(known, asked, exact=True).select("asked", "id").collect()
    found = {(r.asked, r.id) for r in memory.similar(known, asked).select("asked", "id").collect()}
    hits = sum((r.asked, r.id) in found for r in exact)
    assert len(exact) >= 400 and hits / len(exact) >= 0.9
    # plain code for some of them
    rows = [(r.id, {e.dim: e.n for e in r.vector}) for r in known.collect()]
    vectors = dict(rows)

    def cosine(a, b):
        dot = sum(n * b.get(d, 0) for d, n in a.items())
        return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5

    for name in sorted({r.asked for r in exact})[:5]:
        best = sorted((-cosine(vectors[name], v), i) for i, v in rows)[: vocab.RETRIEVAL_K]
        assert sorted(i for _, i in best) == sorted(r.id for r in exact if r.asked == name)


def test_similar_fields_speak_in_inference(spark):
    recs = [{"kontaktadresse": f"ann{i}@acme.com", "fname": "Ann"} for i in range(5)]
    profile = profile_source(frame(spark, {"facebook": recs}))
    rows = [("old::kontaktadressen", "old", "kontaktadressen", "email", ["bo1@acme.com", "ann2@acme.com"])]
    known = spark.createDataFrame(rows, "id string, source string, field string, transform string, samples array<string>").withColumn(
        "vector", memory.field_vector(F.col("field"), F.col("samples"))
    )
    without = {r.field: r.transform for r in inference.infer_mapping(profile, attempt=2).collect()}
    got = {r.field: r.transform for r in inference.infer_mapping(profile, known, attempt=2).collect()}
    assert without["kontaktadresse"] == "ignore" and got["kontaktadresse"] == "email"


def test_memory_of_no_rows_and_short_descriptions(spark):
    known = remembered(spark, 3)
    asked = spark.createDataFrame([("a", [])], "asked string, vector array<struct<dim:int,n:int>>")
    assert memory.similar(known, asked).isEmpty()
    some = known.select(F.col("id").alias("asked"), "vector")
    assert memory.similar(known.limit(0), some).isEmpty()
    assert memory.similar(known, some).groupBy("asked").count().filter("count = 3").count() == 3


def test_a_description_is_hashed_once(spark):
    texts = ["", "ab", "abc", "aaaaaa", "Customer#000000123 BUILDING", "née 🚀 x1"]

    def counters(text: str) -> list[tuple[int, int]]:
        text = re.sub("[0-9]", "0", text.lower())
        grams = [text[i : i + memory.GRAM] for i in range(len(text) - memory.GRAM + 1)]
        found = Counter(int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % memory.DIMENSIONS for g in grams)
        return sorted(found.items())

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", memory.text_vector(F.col("t")).alias("v"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") == 1
    assert {r.t: [(e.dim, e.n) for e in r.v] for r in frame.collect()} == {t: counters(t) for t in texts}
