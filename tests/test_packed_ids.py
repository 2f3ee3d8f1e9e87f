"""Ids of uuid shape travel as 16 bytes, rows of a step once, and keys are counted by bucket."""

import random
import uuid

from pyspark.sql import functions as F

from contactlake.operators import entities, skew
from contactlake.session import Scratch

from .test_entities import union_find

COLUMNS = "lead_id string, first_name string, last_name string, phone_e164 string, email string, source string, quality_score int, status string"


def _leads(spark, rng, ids):
    rows = [
        (i, rng.choice(["Ann", "Bob", None]), rng.choice(["Lee", "Smith"]), f"+1555{rng.randint(0, 40):07}",
         rng.choice([None, f"p{rng.randint(0, 60)}@x.co"]), rng.choice(["facebook", "instagram"]), rng.choice([40, 60, 90]),
         rng.choice(["clean", "clean", "duplicate", None]))
        for i in ids
    ]
    return spark.createDataFrame(rows, COLUMNS)


def _uuids(rng, n):
    return [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n)]


def _all(result):
    return {
        "leads": sorted((str(tuple(r)) for r in result.leads.collect())),
        "summary": tuple(result.summary().first()),
        **{n: sorted(str(tuple(r)) for r in getattr(result, n).collect()) for n in ("components", "groups", "losers", "candidates")},
    }


def _widths(monkeypatch):
    """The types of the ids whose components are looked for."""
    seen, components = [], entities.connected_components

    def noted(edges, *others):
        seen.append(edges.dtypes[0][1])
        return components(edges, *others)

    monkeypatch.setattr(entities, "connected_components", noted)
    return seen


def test_packed_and_written_out_ids_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    ids = _uuids(rng, 150)
    leads = _leads(spark, rng, [*ids, *ids[:20], None, None])
    seen = _widths(monkeypatch)
    short = _all(entities.resolve_entities(leads))
    monkeypatch.setattr(entities, "UUID", "^never$")
    assert _all(entities.resolve_entities(leads)) == short
    assert seen == ["binary", "string"]
    assert short["losers"] and len(short["leads"]) == 172


def test_ids_of_other_shapes_stay_as_they_are(spark, monkeypatch):
    rng = random.Random(9)
    seen = _widths(monkeypatch)
    for other in ("7", "ABCDEF01-0000-0000-0000-000000000000", "abcdef0100000000000000000000000000000000"):
        ids = [*_uuids(rng, 40), other]
        result = entities.resolve_entities(_leads(spark, rng, ids))
        assert {r.lead_id for r in result.leads.collect()} == set(ids)
    assert seen == ["string"] * 3


def test_bytes_keep_the_order(spark):
    df = spark.createDataFrame([(i,) for i in _uuids(random.Random(10), 200)], "id string").withColumn("code", entities.packed(F.col("id")))
    assert [r.id for r in df.orderBy("id").collect()] == [r.id for r in df.orderBy("code").collect()]
    assert df.filter(entities.unpacked(F.col("code")) != F.col("id")).isEmpty()
    assert df.select(entities.unpacked(F.lit(None).cast("binary"))).first()[0] is None


def test_leads_that_share_both_keys_take_no_round(spark, monkeypatch):
    """A phone's star whose leads also share e-mails in pairs: the edges close triangles."""
    edges = [(f"{i}-0", f"{i}-{j}") for i in range(30) for j in range(1, 7)]
    edges += [(f"{i}-{j}", f"{i}-{j + 1}") for i in range(30) for j in (1, 3, 5)]
    seen, large_star = [], entities._large_star
    monkeypatch.setattr(entities, "_large_star", lambda *a: seen.append(1) or large_star(*a))
    df = spark.createDataFrame(edges * 2, "a string, b string")
    for floor in (1_000_000, 1):
        rows = entities.connected_components(df, Scratch(spark, "test"), heavy_floor=floor).collect()
        assert {r.node: r.component for r in rows} == union_find(edges) and len(rows) == 30 * 7
    assert not seen


def test_random_graphs_with_hot_nodes(spark):
    rng = random.Random(11)
    for floor in (1_000_000, 1):
        edges = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)]
        edges += [(200, 200 + i) for i in range(1, 30)] + [(260, 260 - i) for i in range(1, 12)]
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        rows = entities.connected_components(df, Scratch(spark, "test"), heavy_floor=floor).collect()
        want = union_find([e for e in edges if e[0] != e[1]])
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_keys_are_counted_by_bucket_first(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for k in range(50) for i in range(1 + 9 * (k == 7))], "k int, i int")
    assert skew.hot_keys(rows, ["k"], 10) is None
    monkeypatch.setattr(skew, "COUNT_BUCKETS", 2)  # all buckets are overfull
    assert [r.k for r in skew.hot_keys(rows, ["k"], 9).collect()] == [7]
    assert skew.hot_keys(rows, ["k"], 10).isEmpty()


def test_blocks_are_not_counted_one_by_one(spark):
    rows = [(f"{i}", "Ann Lee", f"{i // 2}", None) for i in range(40)]
    cands = spark.createDataFrame(rows, "lead_id string, name string, phone_e164 string, email string")
    pairs = entities.block_pairs(cands, len(rows), heavy_floor=2)
    assert pairs.count() == 20
    assert "Aggregate" not in pairs._jdf.queryExecution().sparkPlan().toString()
