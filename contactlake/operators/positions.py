"""Record positions, slices and batches without a global sort.

Positions follow a ``bigint`` order column that is unique per key (a scan
sequence, a table key). Two ways give the same numbers:

* ``run_positions`` where rows come in *runs* of consecutive numbers, as what
  a task read of a file does (``sources.feeds.land``), or what a task sorted
  (``landed_position``). A row's position is its place in its run plus the rows
  of all earlier runs: a count per run, a prefix sum, and a join with the few
  runs. No row moves.
* ``with_position`` for any other frame. Numbering a whole source in one window
  would put it into one task, so rows are numbered inside fixed ranges of the
  order column (at most 2**16 rows each) and the range totals are summed in two
  steps.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from contactlake.session import Scratch

RANGE_BITS = 16
#: numbers given in one task have so many lower bits
TASK_BITS = 33
#: the number of a row in its landed table
AT = "at"
#: the runs of a landed table are broadcast up to so many (about 50 bytes each)
MAX_BROADCAST_RUNS = 200_000

#: adds positions to a frame: ``place(df, keys, order, out)``
Place = Callable[[DataFrame, list[str], str, str], DataFrame]


def with_position(
    df: DataFrame, keys: list[str], order: str = "seq", out: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row within its keys."""
    near, far = "_near", "_far"
    ranged = df.withColumn(near, F.shiftright(F.col(order), RANGE_BITS))
    per_range = (
        ranged.groupBy(*keys, near)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(far, F.shiftright(F.col(near), RANGE_BITS))
    )

    def before(*partition: str, by: str):
        w = Window.partitionBy(*partition).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(w), F.lit(0))

    per_far = (
        per_range.groupBy(*keys, far)
        .agg(F.sum("_rows").alias("_rows"))
        .select(*keys, far, before(*keys, by=far).alias("_far_offset"))
    )
    offsets = (
        per_range.withColumn("_near_offset", before(*keys, far, by=near))
        .join(per_far, [*keys, far])
        .select(*keys, near, (F.col("_near_offset") + F.col("_far_offset")).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, near).orderBy(order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, near])
        .withColumn(out, F.col("_offset") + F.col("_rank") - F.lit(1))
        .select(*df.columns, out)
    )


def numbered_runs(df: DataFrame) -> DataFrame:
    """Number the rows where they are, in their present order; those of a task are consecutive."""
    return df.withColumn(AT, F.monotonically_increasing_id())


def run_positions(
    df: DataFrame, run: list[str], number: str, outs: Mapping[str, list[str]], by: list[str], scratch: Scratch,
    order: str | None = None,
) -> DataFrame | None:
    """Positions from runs of rows whose ``number`` is consecutive, without an exchange of the rows.

    ``outs`` names the positions and the columns within which each counts; the
    runs of these are ordered by ``by`` (columns of the run, or ``_low``, the
    least of ``order``). The runs are counted once and stored. None if they are
    no runs, or overlap in ``order``. More than ``MAX_BROADCAST_RUNS`` of them
    are joined by Spark's own choice instead of a broadcast.
    """
    keys = list(dict.fromkeys([*(k for ks in outs.values() for k in ks), *run]))
    low, high = (F.min(order), F.max(order)) if order else (F.min(number), F.max(number))
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(number).alias("_first"), F.max(number).alias("_last"),
        low.alias("_low"), high.alias("_high"),
    )
    whole = F.col("_last") - F.col("_first") + 1 == F.col("_rows")
    found: dict[str, Column] = {}
    for out, within in outs.items():
        in_order = Window.partitionBy(*within).orderBy(*by)  # one row per run
        earlier = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        found[f"_{out}_offset"] = F.coalesce(earlier, F.lit(0))
        if order:
            whole = whole & F.coalesce(F.col("_low") > F.lag("_high").over(in_order), F.lit(True))
    offsets = [c.alias(name) for name, c in found.items()]
    runs = scratch.put("runs-" + "-".join(outs), counted.select(*keys, "_first", *offsets, whole.alias("_whole")))
    n, apart = runs.agg(F.count(F.lit(1)), F.coalesce(F.bool_and("_whole"), F.lit(True))).head()
    if not apart:
        return None
    runs = runs.drop("_whole")
    runs = F.broadcast(runs) if n <= MAX_BROADCAST_RUNS else runs
    inside = F.col(number) - F.col("_first")
    return df.join(runs, keys).select(*df.columns, *[(F.col(f"_{out}_offset") + inside).alias(out) for out in outs])


def landed_position(
    df: DataFrame, keys: list[str], order: str = "seq", out: str = "pos", scratch: Scratch | None = None
) -> DataFrame:
    """The same as ``with_position`` for rows numbered by ``numbered_runs``, where they are.

    If the order column does not follow the files, ``with_position`` does it.
    """
    scratch = scratch or Scratch(df.sparkSession, "runs")
    ranged = df.withColumn("_run", F.shiftright(AT, TASK_BITS))
    placed = run_positions(ranged, ["_run"], AT, {out: keys}, ["_low"], scratch, order)
    return with_position(df, keys, order, out) if placed is None else placed.drop("_run")


def slice_records(
    df: DataFrame, skip: int = 0, limit: int | None = None, keys: tuple[str, ...] = ("source",),
    order: str = "seq", place: Place = with_position,
) -> DataFrame:
    """Skip the first records of each source, then keep at most ``limit``; rows may bring their ``pos``."""
    kept = df if "pos" in df.columns else place(df, list(keys), order, "pos")
    if skip:
        kept = kept.filter(F.col("pos") >= skip)
    if limit is not None:
        kept = kept.filter(F.col("pos") < skip + limit)
    return kept


def form_batches(
    df: DataFrame, batch_size: int, keys: tuple[str, ...] = ("source",), order: str = "seq",
    place: Place = with_position, skip: int = 0, limit: int | None = None,
) -> DataFrame:
    """``batch_id`` and ``batch_pos`` of consecutive records per source, of a slice of it if one is asked for.

    A feed that already has a batch key (file, load date, micro-batch) does
    not need this step; see ``number_batches``.
    """
    pos = F.col("pos") - F.lit(skip)
    return slice_records(df, skip, limit, keys, order, place).select(
        *[c for c in df.columns if c != "pos"],
        F.floor(pos / batch_size).cast("bigint").alias("batch_id"),
        (pos % batch_size).cast("bigint").alias("batch_pos"),
    )


def number_batches(df: DataFrame, batch: str, keys: tuple[str, ...] = ("source",), order: str = "seq") -> DataFrame:
    """Use an existing batch column; only the position inside it is computed."""
    return with_position(df.withColumn("batch_id", F.col(batch)), [*keys, "batch_id"], order, "batch_pos")


def number_sorted(df: DataFrame, order: list, scratch: Scratch, out: str = "pos") -> DataFrame:
    """All rows with their 0-based place in a total order, without a window over them.

    Rows are range-partitioned and sorted once and stored with their place in
    their partition; what lies before a partition is a prefix sum over one
    count per partition. Rows equal in ``order`` are placed anyhow.
    """
    part = "_part"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = scratch.put(f"sorted-{out}", numbered_runs(sorted_))
    # a partition's number stands in the upper bits of the ids given in it
    numbered = stored.withColumn(part, F.shiftright(AT, TASK_BITS))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_rows")).select(
        part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.col(AT).bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return numbered.join(F.broadcast(offsets), part).withColumn(out, F.col("_offset") + inside).drop(
        AT, part, "_offset"
    )


def first_per_group(
    df: DataFrame, keys: list[str], order: list, n: int, lanes: int = 256
) -> DataFrame:
    """The first ``n`` rows of each group, for groups of any size.

    Each task keeps its own first ``n`` per group before anything is
    shuffled; the survivors of a group are then reduced in parallel lanes and
    only ``lanes * n`` rows per group meet in one place.
    """
    lane, rank = "_lane", "_rank"
    laned = df.withColumn(lane, F.pmod(F.spark_partition_id(), F.lit(lanes)))
    in_lane = Window.partitionBy(*keys, lane).orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        laned.withColumn(rank, F.row_number().over(in_lane))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(overall))
        .filter(F.col(rank) <= n)
        .drop(lane, rank)
    )
