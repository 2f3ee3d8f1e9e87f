"""Similarity, blocking and components against plain Python."""

import random

from pyspark.sql import functions as F

from contactlake.functions import similarity as S
from contactlake.operators import entities
from contactlake.operators.upsert import latest_by_key, upsert
from contactlake.session import Scratch


def lcs(a, b):
    row = [0] * (len(a) + 1)
    for ch in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(row[i] + 1 if x == ch else max(row[i + 1], new[i]))
        row = new
    return row[-1]


def test_lcs_of_any_length(spark):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("abcdé 😀") for _ in range(n))

    pairs = [(word(rng.randint(0, 30)), word(rng.randint(0, 30))) for _ in range(200)]
    pairs += [(word(62), word(62)), (word(63), word(80)), (word(70), word(5)), (word(100), word(100))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(S.lcs_length(F.col("a"), F.col("b"))).collect()]
    assert got == [lcs(a, b) for a, b in pairs]


def test_name_match_examples(spark):
    rows = [
        ("Angela Brown", "Brown Angela", True),
        ("Angela Brown", "Angela Browne", True),
        ("Lisa Smith", " ", True),
        ("abc", "xyz", False),
        ("Al", "Alexandra Constantinopolis", False),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    match = S.names_match(S.sorted_tokens(F.col("a")), S.sorted_tokens(F.col("b")))
    assert [r[0] for r in df.select(match == F.col("want")).collect()] == [True] * len(rows)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("s000", f"s{i:03}") for i in range(1, 120)]
    loose = [(f"n{rng.randint(0, 150):03}", f"n{rng.randint(0, 150):03}") for _ in range(90)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string")
    want = union_find(edges)
    for floor in (1_000_000, 20):  # 20: the star centre takes the heavy path
        got = entities.connected_components(df, Scratch(spark, "test"), heavy_floor=floor)
        assert {r.node: r.component for r in got.collect()} == want
    assert entities.connected_components(df.filter("false"), Scratch(spark, "test")).isEmpty()


def brute_force(rows):
    """rows: (lead_id, first, last, phone, email, source, score)."""
    rows = sorted(rows)
    edges = []
    for key in (3, 4):
        first = {}
        for r in rows:
            if not r[key]:
                continue
            if r[key] not in first:
                first[r[key]] = r
                continue
            x, y = (" ".join(sorted(f"{p[1] or ''} {p[2] or ''}".split())) for p in (first[r[key]], r))
            if not x or not y or 200 * lcs(x, y) >= 55 * (len(x) + len(y)):
                edges.append((first[r[key]][0], r[0]))
    component = union_find(edges)
    by_id = {r[0]: r for r in rows}
    groups = {}
    for node, root in component.items():
        groups.setdefault(root, []).append(by_id[node])
    losers = set()
    for members in groups.values():
        members.sort(key=lambda r: (-r[6], r[0]))
        losers |= {m[0] for m in members[1:]}
    cross = sum(len({m[5] for m in members}) > 1 for members in groups.values())
    return len(losers), cross, losers


def test_resolution_against_brute_force(spark):
    rng = random.Random(5)
    firsts, lasts = ["Ann", "Bob", "Carla", None, "Annabel"], ["Lee", "Smith", None, "Smythe"]
    rows = []
    for i in range(300):
        phone = "+15550000000" if rng.random() < 0.35 else rng.choice([None, "", f"+1555{rng.randint(0, 60):07}"])
        email = rng.choice([None, f"p{rng.randint(0, 80)}@x.co"])
        rows.append((
            f"id{i:04}", rng.choice(firsts), rng.choice(lasts), phone, email,
            rng.choice(["facebook", "instagram"]), rng.choice([40, 60, 60, 90]),
        ))
    columns = "lead_id string, first_name string, last_name string, phone_e164 string, email string, source string, quality_score int"
    leads = spark.createDataFrame(rows, columns).withColumn("status", F.lit("clean"))
    result = entities.resolve_entities(leads.repartition(5))
    duplicates, cross, losers = brute_force(rows)
    summary = result.summary().first()
    assert (summary.scanned, summary.duplicates, summary.cross_source_groups) == (300, duplicates, cross)
    marked = {r.lead_id for r in result.leads.filter("status = 'duplicate'").collect()}
    assert marked == losers and result.leads.count() == 300
    # a second run over the marked table finds nothing new among survivors' groups
    total = 300
    heavy = entities.matched_edges(entities.candidates(leads), total, heavy_floor=5)
    light = entities.matched_edges(entities.candidates(leads), total)
    assert sorted(map(tuple, heavy.collect())) == sorted(map(tuple, light.collect()))


def test_no_pairs_within_a_block(spark):
    rows = [(f"id{i:05}", "Ann Lee", "+15550000000", None, "facebook", 50) for i in range(3000)]
    cands = spark.createDataFrame(
        rows, "lead_id string, name string, phone_e164 string, email string, source string, quality_score int"
    )
    assert entities.block_pairs(cands, 3000).count() == 2999


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "lead_id string, v int, ingested_at int")
    new = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 1, 2)], "lead_id string, v int, ingested_at int")
    got = sorted(tuple(r) for r in upsert(old, new).collect())
    assert got == [("a", 1, 1), ("b", 3, 3), ("c", 1, 2)]
    assert latest_by_key(new, "lead_id", "ingested_at").count() == 2


def test_finished_stars_take_no_further_round(spark, monkeypatch):
    stars = [(f"a{i:03}", f"b{i:03}-{j}") for i in range(100) for j in range(3)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(7)]
    seen, large_star = [], entities._large_star

    def counted(edges, *others):
        seen.append(edges.count())
        return large_star(edges, *others)

    monkeypatch.setattr(entities, "_large_star", counted)
    got = entities.connected_components(spark.createDataFrame(stars + chain, "a string, b string"), Scratch(spark, "test"))
    assert {r.node: r.component for r in got.collect()} == union_find(stars + chain)
    assert seen and max(seen) <= len(chain)


def test_block_rows_are_shuffled_once(spark):
    rows = [("b", "Ann Lee", "1", "x"), ("a", "Lee Ann", "1", None), ("c", "Bo", None, "x"), ("d", "Cy", "", "y"), (None, "Di", "2", "y")]
    cands = spark.createDataFrame(rows, "lead_id string, name string, phone_e164 string, email string")
    want = {("phone_e164", "a", "Ann Lee", "b", "Ann Lee"), ("email", "b", "Ann Lee", "c", "Bo")}
    for floor in (1_000_000, 1):  # 1: every block of several leads is a hot one
        pairs = entities.block_pairs(cands, len(rows), heavy_floor=floor)
        assert {tuple(r) for r in pairs.collect()} == want
    light = entities.block_pairs(cands, len(rows))
    plan = light._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "Join" not in plan and "Aggregate" not in plan
