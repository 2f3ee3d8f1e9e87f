"""Repair of conversation structure by lightest derivations.

A conversation should read: at most one system turn, then user and assistant
in turn, ending with the assistant. Rows may be kept, given another role or
deleted, and empty turns inserted, each at a cost. The cheapest repair is a
lightest derivation in a weighted hypergraph, found by Knuth's agenda: items
are deduced from finalised items by superior functions of their weights (cost,
audit), the agenda pops the least weight, and a popped item is final.

Items are the edits of a row, the two insertions, and ``dialogues``: what the
first rows, edited, leave behind. An audit is the edits' initials in order.
Two audits of one dialogue never begin one another, since the edits of equally
many rows end in a row's edit and each insertion costs, so appending keeps
their order and the functions are monotone.

Long conversations are cut. Rows are sorted over the whole table into
partitions; the part of a conversation in one partition is taken in chunks, and
a chunk's lightest derivations between all pairs of states (what the last turn
was) are all that matters of it: chains of chunks, and of parts, are composed
by their costs and the order of their audits, then the chosen states are handed
back down. Nothing of a conversation but its audit meets in one place.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from contactlake.session import Scratch

# Costs of the edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: initials of the roles in order; the empty one stands for no turn yet
STATES = ("", "s", "u", "a")
#: which turn may follow which; a dialogue may end after these
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
FINAL = ("", "a")
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")

#: names of the faults and their marks
FAULTS = {"blank": "b", "duplicate": "d", "truncated": "t"}
#: of so many checksums five damage a row
DAMAGE_CASES = 20

#: rows of a chunk; chunks that a worker remembers
CHUNK, REMEMBERED = 256, 20_000
#: rows of a sorted partition, about
PART_ROWS = 500_000
#: rows sent back by a worker at once
OUT_ROWS = 1000
#: characters of role and text that order rows of one turn before their digest does
SORTED_CHARS = 32

Weight = tuple[int, str]


# -- derivations -------------------------------------------------------------------


def _edits(code: str) -> Iterator[tuple[str, str, int]]:
    """Edits of a row as (initial, role initial or "", cost).

    The code is the role's initial (x: another), a capital if the text is
    truncated, or ``-`` if the row must go.
    """
    yield "D", "", DELETE
    if code == "-":
        return
    own, more = code.lower(), TRUNCATED if code.isupper() else 0
    if own in STATES:
        yield "K", own, KEEP + more
    for role in ROLES:
        if role != own:
            yield "R", role, REROLE + more


def derive(codes: str, entry: str, closes: bool) -> dict[str, Weight]:
    """Lightest (cost, audit) of the rows from state ``entry`` on.

    With ``closes`` the conversation ends here: one weight, under ``goal``.
    Otherwise one per state that the rows can leave; nothing is inserted after
    the last row, as that can be done before the next one.
    """
    end, chart = len(codes), {}
    agenda: list[tuple[int, str, tuple]] = [(0, "", ("dialogue", 0, entry, False))]
    agenda += [(cost, "", ("row", i, edit, role)) for i, code in enumerate(codes) for edit, role, cost in _edits(code)]
    agenda += [(INSERT, "", ("insert", role)) for role in ROLES]
    heapq.heapify(agenda)
    dialogues: list[list[tuple]] = [[] for _ in range(end + 1)]
    rows: list[list[tuple]] = [[] for _ in range(end + 1)]
    inserts: list[tuple] = []
    found: dict[str, Weight] = {}

    def deduce(dialogue: tuple, other: tuple) -> None:
        """The consequence of a dialogue and a row's edit or an insertion, if the turn may follow."""
        _, i, state, _ = dialogue
        (cost, audit), (more, _) = chart[dialogue], chart[other]
        if other[0] == "insert":
            letter, role, item = "I", other[1], ("dialogue", i, other[1], True)
            if i == end and not closes:
                return
        else:
            letter, role = other[2], other[3]
            item = ("dialogue", i + 1, role or state, False)
        if (not role or (state, role) in FOLLOWS) and item not in chart:
            heapq.heappush(agenda, (cost + more, audit + letter, item))

    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = (cost, audit)
        if item[0] == "goal":
            return {"goal": (cost, audit)}
        if item[0] == "dialogue":
            i, state = item[1], item[2]
            dialogues[i].append(item)
            if i == end:
                if closes and state in FINAL:
                    heapq.heappush(agenda, (cost, audit, ("goal",)))
                elif not closes and not item[3]:
                    found[state] = (cost, audit)
                    if len(found) == len(STATES):
                        break
            for other in rows[i] + inserts:
                deduce(item, other)
        elif item[0] == "row":
            rows[item[1]].append(item)
            for dialogue in dialogues[item[1]]:
                deduce(dialogue, item)
        else:
            inserts.append(item)
            for dialogue in [d for here in dialogues for d in here]:
                deduce(dialogue, item)
    return found


@lru_cache(REMEMBERED)
def _derived(codes: str, entry: str, closes: bool) -> dict[str, Weight]:
    return derive(codes, entry, closes)


#: per state its cost and the place of its audit among those of the other states
Ranked = dict[str, tuple[int, int]]


def _ranked(reached: dict[str, tuple[int, tuple]]) -> Ranked:
    order = {audit: n for n, audit in enumerate(sorted(audit for _, audit in reached.values()))}
    return {state: (cost, order[audit]) for state, (cost, audit) in reached.items()}


def _step(before: Ranked, spans: dict[str, dict[str, tuple]]) -> tuple[Ranked, dict[str, str]]:
    """One link further: ``spans[p][q]`` is (cost, audit or its place) from p to q. Also the best p per q.

    Audits that lead to different states differ before either ends, so the
    places so far decide first, and those of the link among equals.
    """
    reached, came = {}, {}
    for p, (cost, place) in before.items():
        for q, (more, audit) in spans[p].items():
            weight = (cost + more, (place, audit))
            if q not in reached or weight < reached[q]:
                reached[q], came[q] = weight, p
    return _ranked(reached), came


_CLOSING = {"": (0, ""), "a": (0, ""), "u": (INSERT, "I"), "s": (2 * INSERT, "II")}


def _close(last: Ranked) -> tuple[int, str]:
    """Total cost and last state of the lightest whole repair."""
    return min((cost + _CLOSING[q][0], place, q) for q, (cost, place) in last.items())[::2]


def _chunks(codes: str) -> list[str]:
    return [codes[i : i + CHUNK] for i in range(0, len(codes), CHUNK)]


def _spans(chunk: str, states) -> dict[str, dict[str, Weight]]:
    return {p: _derived(chunk, p, False) for p in states}


def part_spans(codes: str) -> dict[str, Ranked]:
    """Costs of a part, and the order of its audits, between all pairs of states."""
    found = {}
    for entry in STATES:
        reached: Ranked = {entry: (0, 0)}
        for chunk in _chunks(codes):
            reached, _ = _step(reached, _spans(chunk, reached))
        found[entry] = reached
    return found


def part_repair(codes: str, entry: str, leaves: str | None) -> Weight:
    """Cost and audit of a part from ``entry`` to ``leaves``; None: to the end of the conversation."""
    chunks = _chunks(codes)
    if len(chunks) == 1 and leaves is None:
        return _derived(codes, entry, True)["goal"]
    reached, back = {entry: (0, 0)}, []
    for chunk in chunks:
        reached, came = _step(reached, _spans(chunk, reached))
        back.append(came)
    cost, state = _close(reached) if leaves is None else (reached[leaves][0], leaves)
    audits = [_CLOSING[state][1]] if leaves is None else []
    for chunk, came in zip(reversed(chunks), reversed(back)):
        audits.append(_derived(chunk, came[state], False)[state][1])
        state = came[state]
    return cost, "".join(reversed(audits))


def _code(symbols: str, faults: str) -> str:
    return "".join("-" if f in "bd" else s.upper() if f == "t" else s for s, f in zip(symbols, faults))


def illegal_pairs(symbols: str) -> int:
    """Neighbours of which the second may not follow the first."""
    return sum(pair not in FOLLOWS for pair in zip(symbols, symbols[1:]))


# -- jobs --------------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """What was found: stored tables, keyed by ``conv`` and, for parts of it, by ``part``.

    ``rows`` are the sorted rows (conv, part, at, turn, role, text); ``parts``
    the audits (conv, part, first_at, audit); ``facts`` one row per
    conversation with its counts, cost and whole audit.
    """

    rows: DataFrame
    parts: DataFrame
    facts: DataFrame


def _sorted_rows(rows: DataFrame, key: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """All rows in the order of key, turn, role and text, numbered by ``at`` in that order."""
    clean = rows.select(
        F.col(key).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        # equal rows may stand anyhow; this lets them spread over partitions
        F.monotonically_increasing_id().alias("salt"),
    ).withColumn("digest", F.unhex(F.sha1(F.concat_ws("\n", "role", "text"))))
    order = [
        F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.substring("role", 1, SORTED_CHARS),
        F.substring("text", 1, SORTED_CHARS), F.col("digest"), F.col("salt"),
    ]
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    placed = clean.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = placed.drop("salt").withColumn("at", F.monotonically_increasing_id())
    return scratch.put("rows", numbered).withColumn("part", F.shiftright("at", 33))


def _marked(rows: DataFrame) -> DataFrame:
    """Per conversation and partition its rows as two strings: role initials, and faults without their repeats."""
    initial = F.substring("role", 1, 1)
    ended = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv", "part", "at",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("symbol"),
        F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(*STOPS), ".").otherwise("t").alias("fault"),
    )
    firsts = rows.groupBy("conv", "digest").agg(F.min("at").alias("at"))
    seen = firsts.select(
        "conv", F.shiftright("at", 33).alias("part"), "at", F.lit(None).cast("string").alias("symbol"),
        F.lit(None).cast("string").alias("fault"),
    )
    row = F.struct("at", "symbol", F.when((F.col("fault") != "b") & ~F.col("first"), "d").otherwise(F.col("fault")).alias("fault"))
    together = narrow.unionByName(seen).repartition("conv", "part")  # at most the rows of one sorted partition
    return (
        together.groupBy("conv", "part", "at")
        .agg(F.max("symbol").alias("symbol"), F.max("fault").alias("fault"), F.bool_or(F.col("symbol").isNull()).alias("first"))
        .groupBy("conv", "part")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select(
            "conv", "part", F.get("rows", F.lit(0))["at"].alias("first_at"),
            F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"),
            F.array_join(F.transform("rows", lambda r: r["fault"]), "").alias("faults"),
        )
    )


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@F.pandas_udf(_struct(cost=T.LongType(), audit=T.StringType()))
def _repair_part(symbols: pd.Series, faults: pd.Series, entry: pd.Series, leaves: pd.Series) -> pd.DataFrame:
    rows = [
        part_repair(_code(s, f), p, None if pd.isna(q) else q) for s, f, p, q in zip(symbols, faults, entry, leaves)
    ]
    return pd.DataFrame(rows, columns=["cost", "audit"])


@F.pandas_udf(_struct(cost=T.ArrayType(T.LongType()), place=T.ArrayType(T.LongType())))
def _span_part(symbols: pd.Series, faults: pd.Series) -> pd.DataFrame:
    """All pairs of states, row by row; -1 where the rows do not lead from one to the other."""
    rows = []
    for s, f in zip(symbols, faults):
        spans = part_spans(_code(s, f))
        pairs = [spans[p].get(q, (-1, -1)) for p in STATES for q in STATES]
        rows.append(([c for c, _ in pairs], [r for _, r in pairs]))
    return pd.DataFrame(rows, columns=["cost", "place"])


@F.pandas_udf(T.ArrayType(_struct(part=T.LongType(), entry=T.StringType(), leaves=T.StringType())))
def _choose(parts: pd.Series) -> pd.Series:
    """The states between the parts of a conversation on its lightest repair."""
    out = []
    for chain in parts:
        reached, back = {"": (0, 0)}, []
        for link in chain:
            pairs = iter(zip(link["span"]["cost"], link["span"]["place"]))
            spans = {p: {q: (int(c), int(r)) for q, (c, r) in zip(STATES, pairs) if c >= 0} for p in STATES}
            reached, came = _step(reached, spans)
            back.append(came)
        _, state = _close(reached)
        chosen, leaves = [], None  # the last part ends the conversation
        for link, came in zip(reversed(list(chain)), reversed(back)):
            chosen.append({"part": link["part"], "entry": came[state], "leaves": leaves})
            state = leaves = came[state]
        out.append(chosen[::-1])
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def _illegal(symbols: pd.Series) -> pd.Series:
    return symbols.map(illegal_pairs)


def _count(column: str, letter: str) -> Column:
    return (F.length(column) - F.length(F.replace(column, F.lit(letter), F.lit("")))).cast("bigint")


def repair(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    scratch: Scratch | None = None,
) -> Repair:
    """The cheapest repair of every conversation, ties by the ASCII-least audit.

    A row is blank (white space only), else a duplicate (role and text of an
    earlier row), else truncated (no ``.!?`` at its end). Null roles and texts
    are one space; a null key is a conversation of its own; null turns come
    first. Rows of one turn are taken by the first ``SORTED_CHARS`` characters
    of role and text, then by their digest; repeated rows are duplicates. An
    empty table gives empty results. Other columns are not read.
    """
    scratch = scratch or Scratch(rows.sparkSession, "repair")
    ordered = _sorted_rows(rows, key, turn, role, text, scratch)
    marked = scratch.put("marked", _marked(ordered))
    # of the conversations in a partition only the last goes on in the next one,
    # so fewer conversations than partitions have several parts
    spanning = marked.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = F.broadcast(spanning.select(F.col("conv").alias("_conv"), F.lit(True).alias("spans")))
    told = marked.join(several, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    whole = told.filter("spans IS NULL").withColumns({"entry": F.lit(""), "leaves": F.lit(None).cast("string")})
    linked = told.filter("spans")
    chains = (
        linked.withColumn("span", _span_part("symbols", "faults"))
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("part", "span"))).alias("chain"))
        .select(F.col("conv").alias("_conv"), F.explode(_choose("chain")).alias("c"))
        .select("_conv", F.col("c.part").alias("_part"), "c.entry", "c.leaves")
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    handed = linked.join(F.broadcast(chains), same).select(*whole.columns)  # two parts a partition at most
    repaired = whole.unionByName(handed).withColumn("r", _repair_part("symbols", "faults", "entry", "leaves"))
    parts = scratch.put(
        "parts",
        repaired.select(
            "conv", "part", "first_at", "entry", "r.cost", "r.audit",
            *[_count("faults", letter).alias(name) for name, letter in FAULTS.items()],
            _illegal("symbols").alias("illegal"),
            F.left("symbols", F.lit(1)).alias("head"), F.right("symbols", F.lit(1)).alias("tail"),
        ),
    )
    return Repair(ordered, parts, _facts(ordered, parts))


def _facts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``."""
    chain = F.sort_array(F.collect_list(F.struct("part", "head", "tail", "audit")))
    counted = parts.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in (*FAULTS, "illegal", "cost")], chain.alias("chain")
    )
    legal = F.array(*[F.lit(a + b) for a, b in sorted(FOLLOWS) if a])
    seams = F.zip_with(
        F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain")),
        lambda a, b: F.concat(a["tail"], b["head"]),
    )
    between = F.size(F.filter(seams, lambda pair: ~F.array_contains(legal, pair)))
    found = counted.select(
        "conv", *FAULTS, (F.col("illegal") + between).cast("bigint").alias("illegal"), "cost",
        F.array_join(F.transform("chain", lambda c: c["audit"]), "").alias("audit"),
    )
    turns = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    return merge_facts(turns, found)


def merge_facts(*tables: DataFrame) -> DataFrame:
    """Tables of one row per ``conv`` side by side; one aggregate joins null keys, too."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table, allowMissingColumns=True)
    return every.groupBy("conv").agg(*[F.max(c).alias(c) for c in every.columns if c != "conv"])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired rows (conv, at, turn, role, text, edit), from audits, each before the rows of its part."""
    nobody = object()
    conv, state, letters, at = nobody, "", iter(""), 0

    def inserted() -> tuple:
        nonlocal state
        state = next(q for q in ROLES if (state, q) in FOLLOWS)
        return conv, at, None, ROLES[state], "", "I"

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "at", "turn", "role", "text", "audit", "entry")]
        for own, at_, turn, role, text, audit, entry in zip(*columns):
            if audit is not None:
                for _ in letters:  # what a conversation's end wants inserted
                    yield inserted()
                conv, state, letters, at = own, entry, iter(audit), at_
                yield conv, at, None, None, None, ""  # a part begins, though nothing may be left of it
                continue
            at = at_
            while (letter := next(letters)) == "I":
                yield inserted()
            if letter == "D":
                continue
            state = role[:1] if letter == "K" else next(q for q in ROLES if (state, q) in FOLLOWS)
            yield conv, at, turn, role if letter == "K" else ROLES[state], text, letter
    for _ in letters:
        yield inserted()


def _replay(found: Repair, together: list[str]) -> DataFrame:
    """Audits and rows, those ``together`` in one partition, each part's audit before its rows."""
    rows = found.rows.select("conv", "part", "at", "turn", "role", "text").withColumns(
        {"audit": F.lit(None).cast("string"), "entry": F.lit(None).cast("string")}
    )
    none = {c: F.lit(None) for c in ("turn", "role", "text")}
    audits = found.parts.select("conv", "part", F.col("first_at").alias("at"), "audit", "entry").withColumns(none)
    every = rows.unionByName(audits)
    return every.repartition(*together).sortWithinPartitions(
        F.asc_nulls_first("conv"), "at", F.col("audit").isNull()
    ).select("conv", "at", "turn", "role", "text", "audit", "entry")


def repaired_rows(found: Repair) -> DataFrame:
    """``(conv, at, step, turn, role, text, edit)``: the rows left and put in, in the order of at and step.

    Inserted rows have no turn. A hot conversation is dealt by its parts.
    """
    key_type = found.rows.schema["conv"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, place = ["conv", "at", "step", "turn", "role", "text", "edit"], [], (None, None, 0)
        types, key = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()], None

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key
            for batch in batches:
                key = batch.schema.field("conv").type
                yield batch

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), [key, *types])], names=names)

        for conv, at, turn, role, text, edit in _replayed(seen(batches)):
            if not edit:
                continue
            step = place[2] + 1 if place[:2] == (conv, at) else 0
            place = (conv, at, step)
            held.append((conv, at, step, turn, role, text, edit))
            if len(held) == OUT_ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    schema = f"conv {key_type.simpleString()}, at bigint, step int, turn bigint, role string, text string, edit string"
    return _replay(found, ["conv", "part"]).mapInArrow(rows, schema)


def repaired_digests(found: Repair) -> DataFrame:
    """``(conv, sha256)`` of ``role:text`` of the repaired rows, joined by line breaks.

    A digest is sequential, so here the texts of one conversation pass through
    one task, row by row and without being held.
    """
    key_type = found.rows.schema["conv"].dataType

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, nobody = [], None, object()
        conv, digest, first = nobody, None, True

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key
            for batch in batches:
                key = batch.schema.field("conv").type
                yield batch

        def flush() -> pa.RecordBatch:
            convs, shas = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(convs, key), pa.array(shas, pa.string())], names=["conv", "sha256"])

        for own, _, _, role, text, edit in _replayed(seen(batches)):
            if own != conv:
                if conv is not nobody:
                    held.append((conv, digest.hexdigest()))
                conv, digest, first = own, hashlib.sha256(), True
                if len(held) >= OUT_ROWS:
                    yield flush()
                    held = []
            if edit:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if conv is not nobody:
            held.append((conv, digest.hexdigest()))
            yield flush()

    return _replay(found, ["conv"]).mapInArrow(digests, f"conv {key_type.simpleString()}, sha256 string")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by the checksum of ``key:turn``: some dropped, emptied, stripped of stops, repeated or given to the user.

    Null keys and turns count as one space in the checksum; null roles and
    texts become one space.
    """
    place = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in (key, ":", turn)])
    case = F.crc32(place.cast("binary")) % DAMAGE_CASES
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(
        key, turn,
        F.when(case == 4, F.lit("user")).otherwise(F.coalesce(F.col(role).cast("string"), F.lit(" "))).alias(role),
        F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 0, 0).when(case == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
