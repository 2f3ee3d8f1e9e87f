"""Which leads are the same person.

Blocks are stars around the first lead of each phone or e-mail, so the work
grows with the rows and not with the pairs of a block; a number shared by a
third of all leads adds one edge per lead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from contactlake import vocab
from contactlake.functions.similarity import names_match, sorted_tokens
from contactlake.operators.skew import HEAVY_FLOOR, heavy_cut, hot_keys, known
from contactlake.session import Scratch

KEYS = ("phone_e164", "email")


def candidates(leads: DataFrame) -> DataFrame:
    """Leads not yet marked, with the name used for comparison."""
    name = F.concat(
        F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))
    )
    return leads.filter(F.col("status") != "duplicate").select(
        "lead_id", name.alias("name"), "phone_e164", "email", "source", "quality_score"
    )


def block_pairs(
    cands: DataFrame, total_rows: int, keys: Sequence[str] = KEYS, heavy_floor: int = HEAVY_FLOOR
) -> DataFrame:
    """Each lead of a block paired with the first one (by ``lead_id``).

    All keys are blocked in one pass, and a row is shuffled once. The names
    travel with their tokens sorted, so that this is done once per lead.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("block"), F.col(k).alias("value")) for k in keys])
    keyed = (
        cands.select("lead_id", sorted_tokens(F.col("name")).alias("name"), F.explode(entries).alias("_e"))
        .select("_e.block", "_e.value", "lead_id", "name")
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
    )
    block = ["block", "value"]

    def paired(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("lead_id") != F.col("first_id")).select("block", "first_id", "first_name", "lead_id", "name")

    in_order = Window.partitionBy(*block).orderBy("lead_id", "name").rowsBetween(Window.unboundedPreceding, 0)
    first = {"first_id": F.first("lead_id").over(in_order), "first_name": F.first("name").over(in_order)}
    cut = heavy_cut(len(keys) * total_rows, heavy_floor)
    if len(keys) * total_rows <= cut or (hot := hot_keys(keyed, block, cut)) is None:
        return paired(keyed.withColumns(first))
    # rows of hot blocks do not enter the shuffle
    hot = F.broadcast(hot)
    light = keyed.join(hot, block, "left_anti").withColumns(first)
    heavy = keyed.join(hot, block)
    least = heavy.groupBy(*block).agg(F.min(F.struct("lead_id", "name")).alias("_first"))
    firsts = least.select(*block, F.col("_first.lead_id").alias("first_id"), F.col("_first.name").alias("first_name"))
    return paired(light).unionByName(paired(heavy.join(F.broadcast(firsts), block)))


def match_pairs(pairs: DataFrame, minimum: float = vocab.NAME_SIMILARITY_MIN) -> DataFrame:
    """Pairs whose names are similar enough, or one of them blank."""
    return pairs.filter(names_match(F.col("first_name"), F.col("name"), minimum))


def _neighbours(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Distinct rows (u, v) with the ``least`` and the ``most`` of all v of their u."""
    own = Window.partitionBy("u")
    ends = {"least": F.min("v"), "most": F.max("v")}
    again = F.equal_null(F.lag("v").over(own.orderBy("v")), F.col("v"))

    def light(rows: DataFrame) -> DataFrame:
        met = rows.withColumns({"_again": again, **{name: value.over(own) for name, value in ends.items()}})
        return met.filter("not _again").drop("_again")

    if hot is None:
        return light(rows)
    hot = F.broadcast(hot.withColumnRenamed("node", "u"))
    heavy = rows.join(hot, "u").distinct()
    facts = F.broadcast(heavy.groupBy("u").agg(*[value.alias(name) for name, value in ends.items()]))
    return light(rows.join(hot, "u", "left_anti")).unionByName(heavy.join(facts, "u"))


def _settled(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Distinct edges (a, b), ``b`` the lesser end, with ``done``: their component is a star around ``b``.

    Every node of a star but its centre has one edge, to the centre. So an edge
    votes against its centre if its other end has another one or is the lesser
    end of one, and against that end as a centre of its own.
    """
    lower = edges.select(F.col("b").alias("u")).distinct().withColumn("lower", F.lit(True))
    grouped = _neighbours(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), hot)
    met = known(grouped, lower, "u", hot and hot.withColumnRenamed("node", "u"))
    leaf = F.col("lower").isNull() & (F.col("least") == F.col("most"))
    ended = met.select(F.col("u").alias("a"), F.col("v").alias("b"), leaf.alias("leaf"))
    ballots = F.array(
        F.struct(F.col("b").alias("centre"), F.col("leaf").alias("star")),
        F.when(~F.col("leaf"), F.struct(F.col("a").alias("centre"), F.lit(False).alias("star"))),
    )
    votes = ended.select(F.explode(F.array_compact(ballots)).alias("_v")).select("_v.*")
    centres = votes.groupBy(F.col("centre").alias("b")).agg(F.bool_and("star").alias("done"))
    return known(ended, centres, "b", hot and hot.withColumnRenamed("node", "b")).select("a", "b", "done")


def _large_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    ends = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    both = edges.select(F.explode(ends).alias("_e")).select("_e.*")
    facts = both.groupBy("u").agg(F.min("v").alias("least"))
    linked = known(both, facts, "u", hot and hot.withColumnRenamed("node", "u")).filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("a"), F.least("u", "least").alias("b"))


def _small_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Every edge (u, v) but the one to the least neighbour is moved to link v with it; an edge may come again."""
    linked = _neighbours(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), hot)
    moved = F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v"))
    return linked.select(moved.alias("a"), F.col("least").alias("b"))


def _hot_nodes(edges: DataFrame, total: int, heavy_floor: int) -> DataFrame | None:
    """Nodes that are the end of very many edges. Moving edges by one round of stars gives no other node as many greater ends."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    cut = heavy_cut(2 * total, heavy_floor)
    return None if 2 * total <= cut else hot_keys(ends, ["node"], cut)


def connected_components(
    edges: DataFrame, scratch: Scratch, heavy_floor: int = HEAVY_FLOOR
) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``.

    Small-star and large-star steps alternate: every edge is moved to the
    least neighbour until all components are stars around their least node.
    Components that are stars are set aside, so a round works on the others
    only. Each round is written to the shared scratch folder, which cuts the
    lineage and survives lost executors; the rounds are in the order of the
    logarithm of the edges.
    """
    pair = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    given = scratch.put("edges-given", edges.filter("a <> b").select(*pair))
    hot = _hot_nodes(given, given.count(), heavy_floor)
    current = scratch.put("edges-0", _small_star(given, hot))
    scratch.drop("edges-given")
    stars = []
    i, most = 0, None
    while total := current.count():
        i, most = i + 1, most or 10 + 4 * total.bit_length()
        if i > most:
            raise RuntimeError(f"components not stable after {most} rounds")
        hot = _hot_nodes(current, total, heavy_floor)
        judged = scratch.put(f"judged-{i}", _settled(current, hot))
        stars.append(judged.filter("done").select("a", "b"))
        left = judged.filter("not done").select("a", "b")
        if left.isEmpty():
            scratch.drop(f"edges-{i - 1}")
            break
        current = scratch.put(f"edges-{i}", _small_star(_large_star(left, hot), hot))
        scratch.drop(f"edges-{i - 1}")
    # Every component is now a star: members point at the root.
    every = reduce(DataFrame.unionByName, stars or [current])
    members = every.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = every.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def survivors(cands: DataFrame, components: DataFrame) -> DataFrame:
    """One row per group with its survivor and what it spans.

    The richest lead survives, ties by ``lead_id``. A pure aggregate, so the
    size of a group does not matter.
    """
    members = components.join(
        cands.select(F.col("lead_id").alias("node"), "source", "quality_score"), "node"
    )
    best = F.min(F.struct((-F.col("quality_score")).alias("_rank"), F.col("node")))
    return (
        members.groupBy("component")
        .agg(
            best.alias("_best"),
            F.count(F.lit(1)).alias("members"),
            (F.min("source") != F.max("source")).alias("cross_source"),
        )
        .select("component", F.col("_best.node").alias("survivor_id"), "members", "cross_source")
    )


def mark_duplicates(leads: DataFrame, losers: DataFrame) -> DataFrame:
    """``status = 'duplicate'`` for the losers; no row is removed."""
    hit = losers.select("lead_id", F.lit(True).alias("_loser"))
    return (
        leads.join(hit, "lead_id", "left")
        .withColumn(
            "status", F.when(F.col("_loser"), F.lit("duplicate")).otherwise(F.col("status"))
        )
        .select(*leads.columns)
    )


#: ids of this shape are half as long in binary form, and in the same order
UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def packed(value: Column) -> Column:
    """The 16 bytes of an id of uuid shape."""
    return F.unhex(F.replace(value, F.lit("-"), F.lit("")))


def unpacked(value: Column) -> Column:
    digits = F.lower(F.hex(value))
    parts = F.concat_ws("-", *[F.substring(digits, *cut) for cut in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(value.isNotNull(), parts)


@dataclass(frozen=True)
class Resolution:
    leads: DataFrame
    components: DataFrame
    groups: DataFrame
    losers: DataFrame
    candidates: DataFrame

    def summary(self) -> DataFrame:
        """Leads scanned, duplicates marked, groups that span sources."""
        none = F.lit(0).cast("bigint")
        groups = self.groups.agg(
            F.coalesce(F.sum(F.col("members") - 1), none).alias("duplicates"),
            F.count_if("cross_source").alias("cross_source_groups"),
        ).select(none.alias("scanned"), "duplicates", "cross_source_groups")
        scanned = self.candidates.agg(F.count(F.lit(1)).alias("scanned")).select(
            "scanned", none.alias("duplicates"), none.alias("cross_source_groups")
        )
        return scanned.unionByName(groups).agg(
            *[F.sum(c).alias(c) for c in ("scanned", "duplicates", "cross_source_groups")]
        )


def matched_edges(
    cands: DataFrame, total_rows: int, keys: Sequence[str] = KEYS,
    minimum: float = vocab.NAME_SIMILARITY_MIN, heavy_floor: int = HEAVY_FLOOR,
) -> DataFrame:
    """D2-D4 over all keys: the edges of the duplicate graph."""
    return match_pairs(block_pairs(cands, total_rows, keys, heavy_floor), minimum).select(
        F.col("first_id").alias("a"), F.col("lead_id").alias("b")
    )


def resolve_entities(
    leads: DataFrame,
    keys: Sequence[str] = KEYS,
    min_similarity: float = vocab.NAME_SIMILARITY_MIN,
    scratch: Scratch | None = None,
) -> Resolution:
    """The whole job over a leads table (which should be a stored one: it is
    read several times)."""
    scratch = scratch or Scratch(leads.sparkSession, "entities")
    cands = candidates(leads)
    shaped = F.coalesce(F.bool_and(F.col("lead_id").rlike(UUID)), F.lit(False))
    total, narrow = leads.agg(F.count_if(F.col("status") != "duplicate"), shaped).head()

    def ids(df: DataFrame, form, *columns: str) -> DataFrame:
        return df.withColumns({c: form(F.col(c)) for c in columns}) if narrow else df

    own = ids(cands, packed, "lead_id")
    components = connected_components(matched_edges(own, total, keys, min_similarity), scratch)
    groups = scratch.put("groups", survivors(own, components))
    losers = components.join(
        groups.select(F.col("survivor_id").alias("node")), "node", "left_anti"
    ).select(F.col("node").alias("lead_id"))
    return Resolution(
        ids(mark_duplicates(ids(leads, packed, "lead_id"), losers), unpacked, "lead_id"),
        ids(components, unpacked, "node", "component"),
        ids(groups, unpacked, "component", "survivor_id"),
        ids(losers, unpacked, "lead_id"),
        cands,
    )
