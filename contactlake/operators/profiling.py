"""M1: what a source looks like: its fields, fill rates, sample values and what its values are.

Records are taken apart once. Every cell is judged where it is, and one
aggregate with map-side combine leaves a row per task, field and lane; no value
is shuffled. Lanes bound where the first values of a field can be: the k-th
least of their first places. Only the cells up to there are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from contactlake import vocab
from contactlake.operators.inference import KINDS, judged
from contactlake.operators.positions import first_per_group

#: lanes into which the records of a field are dealt
LANES = 16


def profile_source(
    df: DataFrame,
    keys: tuple[str, ...] = ("source",),
    order: str = "seq",
    max_rows: int | None = None,
    samples: int = vocab.PROFILE_SAMPLES,
    width: int | None = None,
) -> DataFrame:
    """One row per key and field.

    ``fill_rate`` is the share of the records in which the key is *present* (a
    null or empty value counts); ``samples`` are the first non-empty values in
    record order, for display; ``evidence`` judges all values (null: none to
    judge). ``ordinal`` is the order in which the fields were first seen.
    Every record and whole values count, unless ``max_rows`` asks for the first
    records, or ``width`` for the first characters of samples, only.
    """
    keys_ = list(keys)
    rows = df.filter(F.col("rec").isNotNull()).select(*keys_, F.col(order).alias("_at"), "rec")
    if max_rows is not None:
        rows = first_per_group(rows, keys_, ["_at"], max_rows)
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    # one more cell per record counts the records
    cells = rows.select(*keys_, "_at", F.posexplode(F.array_append(F.map_entries("rec"), none)).alias("_place", "_cell"))
    cells = cells.select(*keys_, "_at", "_place", F.col("_cell.key").alias("field"), F.col("_cell.value").alias("_value"))
    filled = F.col("_value") != ""
    lane = F.pmod(F.xxhash64("_at"), F.lit(LANES)).alias("_lane")
    per_lane = judged(cells).groupBy(*keys_, "field", lane).agg(
        F.count(F.lit(1)).alias("present"),
        F.count(F.when(filled, True)).alias("values"),
        F.min("_at").alias("_first"),
        F.min("_place").alias("_place"),
        F.min(F.when(filled, F.col("_at"))).alias("_from"),
        F.max(F.when(filled, F.col("_at"))).alias("_to"),
        *[F.count(F.when(F.col(kind), True)).alias(kind) for kind in KINDS],
    )
    firsts = F.array_sort(F.array_compact(F.collect_list("_from")))
    values = F.sum("values")
    per_field = per_lane.groupBy(*keys_, "field").agg(
        F.sum("present").alias("present"),
        F.min("_first").alias("_first"),
        F.min("_place").alias("_place"),
        F.coalesce(F.get(firsts, F.lit(samples - 1)), F.max("_to")).alias("_upto"),
        F.when(
            values > 0, F.struct(values.alias("values"), *[(F.sum(kind) / values).alias(kind) for kind in KINDS])
        ).alias("evidence"),
    )
    of_key = Window.partitionBy(*keys_)  # a row per field
    by_sight = of_key.orderBy(F.col("field").isNull(), "_first", "_place", "field")
    fields = per_field.select(
        "*", F.max(F.when(F.col("field").isNull(), F.col("present"))).over(of_key).alias("n"),
        F.max("_upto").over(of_key).alias("_last"), F.row_number().over(by_sight).alias("ordinal"),
    ).filter("field IS NOT NULL")
    # the first values, from the few records that can hold them
    wanted = fields.groupBy(*keys_).agg(
        F.max("_last").alias("_last"), F.map_from_entries(F.collect_list(F.struct("field", "_upto"))).alias("_bounds")
    )
    head = rows.join(wanted, keys_).filter(F.col("_at") <= F.col("_last"))
    early = head.select(*keys_, "_at", "_bounds", F.explode("rec").alias("field", "_value")).filter(
        (F.col("_value") != "") & (F.col("_at") <= F.try_element_at("_bounds", F.col("field")))
    )
    shown = early.groupBy(*keys_, "field").agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_samples"))
    shown = shown.select(
        *keys_, "field",
        F.transform(
            F.slice("_samples", 1, samples),
            lambda s: s["_value"] if width is None else F.left(s["_value"], F.lit(width)),
        ).alias("samples"),
    )
    return fields.join(shown, [*keys_, "field"], "left").select(
        *keys_, "ordinal", "field", "n", "present", F.round(F.col("present") / F.col("n"), 2).alias("fill_rate"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "evidence",
    )
