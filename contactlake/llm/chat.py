"""Chat formatting: a dialogue rendered once from every participant's side.

In a participant's rendering that speaker is the assistant and all other
speakers are users with a name; the mask covers what the assistant says and its
end mark. Long dialogues come in blocks of consecutive turns, so a dialogue of
any length is many rows instead of one long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contactlake.session import Scratch

#: turn numbers in a block
BLOCK_TURNS = 256
#: the role that sets the scene: shown in every rendering, a participant in none
SCENE = "system"
UNNAMED = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def _name(role: Column) -> Column:
    """A role as a name within a header."""
    return F.coalesce(F.translate(role, " \t\n\x0b\x0c\r<>|", "_" * 9), F.lit(UNNAMED))


def _content(text: Column) -> Column:
    """A turn's text; marks of the template in it are broken by a space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _before(a: Column, b: Column) -> Column:
    """Whether turn number a comes before b; null comes first."""
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def _dealt(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of crowded turns in parts of BLOCK_TURNS rows, numbered from ``part`` in the order of role and text.

    Equal rows travel once with their number. A turn's distinct rows lie in
    several sorted ranges; places are counted within a range and summed over
    the ranges, so no task holds a whole turn.
    """
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "content")]
    values = rows.groupBy("conv", "block", "turn", "role", "content", "part").agg(F.count(F.lit(1)).alias("n"))
    ranged = scratch.put(
        "crowded", values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("range", F.shiftright("at", 33))
    earlier = Window.unboundedPreceding, -1
    totals = ranged.groupBy("conv", "turn", "range").agg(F.sum("n").alias("n")).select(
        F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("range").alias("r"),
        F.coalesce(F.sum("n").over(Window.partitionBy("conv", "turn").orderBy("range").rowsBetween(*earlier)), F.lit(0)).alias("ahead"),
    )
    inside = Window.partitionBy("conv", "turn", "range").orderBy("at").rowsBetween(*earlier)
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r"))
    first = F.col("ahead") + F.col("inside")
    placed = (
        ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, same)
        .withColumns({"first": first, "end": first + F.col("n")})
    )
    held = placed.withColumn(
        "i", F.explode(F.sequence(F.floor(F.col("first") / BLOCK_TURNS), F.floor((F.col("end") - 1) / BLOCK_TURNS)))
    )
    times = F.least("end", (F.col("i") + 1) * BLOCK_TURNS) - F.greatest("first", F.col("i") * BLOCK_TURNS)
    parts = held.groupBy("conv", "block", F.col("turn").alias("of_turn"), (F.col("part") + F.col("i")).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content", times.cast("int").alias("times")))).alias("turns")
    )
    again = F.transform(
        "turns", lambda t: F.array_repeat(F.struct(*[t[c].alias(c) for c in ("turn", "role", "content")]), t["times"])
    )
    return parts.withColumn("turns", F.flatten(again))


def _blocks(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns collected by dialogue, block and part, in the order of turn, role and text."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"),
        _content(F.col(text)).alias("content"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK_TURNS).cast("bigint"))
    # one turn number may stand on very many rows: those are cut into parts of a bounded size
    scratch = Scratch(turns.sparkSession, "chat")
    crowds = scratch.put(
        "crowds",
        rows.groupBy("conv", "block", "turn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_TURNS)
        .groupBy(F.col("conv").alias("c"), F.col("block").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", F.ceil(F.col("n") / BLOCK_TURNS).alias("parts")))).alias("crowds")),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("turns")
    none, whole = F.lit(None).cast("bigint").alias("of_turn"), F.lit(0).cast("bigint")
    if crowds.isEmpty():
        return rows.groupBy("conv", "block", none, whole.alias("part")).agg(ordered)
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    ahead = F.aggregate(
        F.filter("crowds", lambda x: _before(x["turn"], F.col("turn"))), whole, lambda a, x: a + x["parts"] + 1
    )
    crowded = F.exists("crowds", lambda x: x["turn"].eqNullSafe(F.col("turn")))
    cut = rows.join(crowds, same, "left").withColumns(
        {"part": F.coalesce(ahead, whole), "crowded": F.coalesce(crowded, F.lit(False))}
    ).drop("c", "b", "crowds")
    rest = cut.filter(~F.col("crowded")).groupBy("conv", "block", none, "part").agg(ordered)
    many = cut.filter("crowded").withColumn("part", F.col("part") + 1).drop("crowded")
    return rest.unionByName(_dealt(many, scratch))


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows ``(conv, speaker, block, part, n_turns, text, masks)``: a dialogue's blocks from every side.

    ``masks`` are spans of code points in the row's ``text``, end exclusive. A
    block holds the turns with the same ``turn / 256``; a part is 0 unless more
    than 256 rows share one turn number, whose rows then form parts of 256 in
    their order. Parts ascend in the order of the turns: 0 before the first such
    turn, then its parts, then what follows it (numbers of empty parts are left
    out), so a block's parts one after the other are its whole rendering, however
    the rows lie in files. Turns are ordered by number,
    role and text, so ties have one result; null turn numbers come first, null
    texts are empty, a null role is a user without a name and no participant.
    A dialogue without participants gives no row; a null dialogue key is a
    dialogue like any other; repeated rows are repeated turns.
    """
    blocks = _blocks(turns, conv, turn, role, text)
    speakers = (
        turns.select(F.col(conv).alias("c"), F.col(role).alias("speaker"))
        .filter(F.col("speaker").isNotNull() & (F.col("speaker") != SCENE)).distinct()
    )
    sides = blocks.join(speakers, F.col("conv").eqNullSafe(F.col("c")))

    def head(t: Column) -> Column:
        return (
            F.when(F.coalesce(t["role"] == F.col("speaker"), F.lit(False)), F.lit(f"{START}assistant\n"))
            .when(F.coalesce(t["role"] == SCENE, F.lit(False)), F.lit(f"{START}{SCENE}\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), _name(t["role"]), F.lit("\n")))
        )

    shown = sides.withColumn(
        "shown",
        F.transform(
            "turns",
            lambda t: F.struct(
                head(t).alias("head"), F.concat(t["content"], F.lit(END)).alias("body"),
                F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("own"),
            ),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + F.length(x["head"])
        last = first + F.length(x["body"])
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + 1).alias("at"), F.concat(a["masks"], F.when(x["own"], span).otherwise(none)).alias("masks"))

    masks = F.aggregate("shown", F.struct(F.lit(0).alias("at"), none.alias("masks")), step, lambda a: a["masks"])
    return shown.select(
        F.col("conv").alias(conv), "speaker", "block",
        F.coalesce("of_turn", F.lit(None).cast("bigint")).alias("of_turn"), F.col("part").cast("bigint").alias("part"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        masks.alias("masks"),
    )
