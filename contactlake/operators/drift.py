"""M2-M5: does the mapping still fit the batches?"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from contactlake import vocab
from contactlake.functions import dates, text
from contactlake.operators.positions import first_per_group
from contactlake.operators.projection import FieldMapping

BATCH = ("source", "batch_id")


def _active(mapping: FieldMapping) -> list[str]:
    return [field for field, transform in mapping.items() if transform != "ignore"]


def _by_route(table: Mapping[str, Column], route: str, empty: Column) -> Column:
    """The value of a row's route: one lookup in a literal map, however many routes there are."""
    if not table:
        return empty
    pairs = F.create_map(*[x for name, value in table.items() for x in (F.lit(name), value)])
    return F.coalesce(F.try_element_at(pairs, F.col(route)), empty)


def _names(fields: list[str]) -> Column:
    return F.array(*[F.lit(f) for f in fields]).cast("array<string>")


def too_late(value: Column) -> Column:
    """Whether a value, taken as a date, lies beyond the year 9999, which no lead may."""
    when = text.strip(value)
    digits = F.when(when.rlike(dates.EPOCH), when.cast("bigint"))
    return (digits > dates.LAST_SECOND) & (digits <= dates.MILLIS_ABOVE)


def record_error(mappings: Mapping[str, FieldMapping], route: str, sources: tuple[str, ...]) -> Column:
    """Why a record cannot become a lead, NULL when it can.

    Exactly the failures the full projection reports for a readable record,
    told from the raw fields alone: the drift test does not clean anything.
    """
    unknown = {
        name: F.lit("unknown_transform:" + t)
        for name, mapping in mappings.items()
        for t in [next((t for t in mapping.values() if t not in vocab.TRANSFORMS), None)]
        if t is not None
    }
    created = {
        name: F.lit(fields[-1])
        for name, mapping in mappings.items()
        if (fields := [f for f, t in mapping.items() if t == "created_at"])
    }
    no_text = F.lit(None).cast("string")
    when = F.try_element_at(F.col("rec"), _by_route(created, route, no_text))
    return (
        F.when(_by_route(unknown, route, no_text).isNotNull(), _by_route(unknown, route, no_text))
        .when(too_late(when), F.lit("created_at_range"))
        .when(~F.col("source").isin(*sources), F.lit("source_unknown"))
    )


def batch_health(
    df: DataFrame,
    mappings: Mapping[str, FieldMapping],
    route: str = "source",
    sources: tuple[str, ...] = vocab.SOURCES,
    missing_over: float = vocab.MISSING_THRESHOLD,
    failed_over: float = vocab.INVALID_THRESHOLD,
) -> DataFrame:
    """M2 and M4 in one aggregation: one row per batch.

    ``missing`` maps every active field to the number of records without the
    key; ``dead_fields`` are those missing in more than ``missing_over`` of
    the batch; ``drifted`` is the decision. Only counters are shuffled. An
    empty batch has no rows and so no decision.
    """
    active = {name: _active(mapping) for name, mapping in mappings.items()}
    slots = max((len(fields) for fields in active.values()), default=0)

    def absent(i: int) -> Column:
        fields = {name: F.lit(fs[i]) for name, fs in active.items() if i < len(fs)}
        key = _by_route(fields, route, F.lit(None).cast("string"))
        return F.sum((~F.array_contains(F.map_keys("rec"), key)).cast("bigint")).alias(f"_miss{i}")

    keys = list(dict.fromkeys([*BATCH, route]))
    error = record_error(mappings, route, sources)
    totals = (
        df.filter(F.col("rec").isNotNull() & F.col(route).isin(*mappings))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(error).alias("failed"),
            *[absent(i) for i in range(slots)],
        )
    )
    names = _by_route({name: _names(fs) for name, fs in active.items()}, route, _names([]))
    counts = F.array(*[F.col(f"_miss{i}") for i in range(slots)]).cast("array<bigint>")
    missing = F.map_from_arrays(names, F.slice(counts, F.lit(1), F.size(names)))
    return (
        totals.select(*keys, "n", "failed", missing.alias("missing"))
        .withColumn(
            "dead_fields",
            F.map_keys(F.map_filter("missing", lambda _, c: c / F.col("n") > missing_over)),
        )
        .withColumn(
            "drifted",
            (F.size("dead_fields") > 0) | (F.col("failed") / F.col("n") > failed_over),
        )
    )


def missing_counts(health: DataFrame) -> DataFrame:
    """M2: one row per batch and active field."""
    return health.select(*BATCH, "n", F.explode("missing").alias("field", "missing"))


def unmapped_fields(
    df: DataFrame,
    mappings: Mapping[str, FieldMapping],
    route: str = "source",
    order: str = "batch_pos",
    rows: int | None = None,
) -> DataFrame:
    """M3: keys of a batch's records (the first ``rows``, if given) that the mapping does not name."""
    known = {name: _names(list(mapping)) for name, mapping in mappings.items()}
    no_names = F.array().cast("array<string>")
    return (
        df.filter(F.col("rec").isNotNull() & (F.lit(True) if rows is None else F.col(order) < rows))
        .select(
            *BATCH,
            F.explode(
                F.array_except(F.map_keys("rec"), _by_route(known, route, no_names))
            ).alias("field"),
        )
        .distinct()
    )


@dataclass(frozen=True)
class Verdict:
    """How a mapping fits a batch, told from the batch's signature alone."""

    dead: tuple[str, ...]
    failed: int
    drifted: bool


def judge(
    mapping: FieldMapping, n: int, present: Mapping[str, int], late: Mapping[str, int], known_source: bool = True,
    missing_over: float = vocab.MISSING_THRESHOLD, failed_over: float = vocab.INVALID_THRESHOLD,
) -> Verdict:
    """The decision of ``batch_health`` for one batch of ``n`` records and any mapping.

    ``present`` and ``late`` count, per field, the records with the key and the
    values that are too late as a date (see ``signatures``).
    """
    dead = tuple(f for f in _active(mapping) if (n - present.get(f, 0)) / n > missing_over)
    created = [f for f, t in mapping.items() if t == "created_at"]
    hopeless = not known_source or any(t not in vocab.TRANSFORMS for t in mapping.values())
    failed = n if hopeless else late.get(created[-1], 0) if created else 0
    return Verdict(dead, failed, bool(dead) or failed / n > failed_over)


def signatures(
    df: DataFrame, order: str = "batch_pos", missing_over: float = vocab.MISSING_THRESHOLD,
    failed_over: float = vocab.INVALID_THRESHOLD,
) -> DataFrame:
    """One row per batch with all that the drift test of any mapping needs.

    ``fields`` holds (field, present, late); ``first_keys`` the keys of the
    first record; ``layout`` is a digest of the fields that no mapping would
    miss; ``late`` tells whether some field alone could fail the batch. Only
    counters are shuffled, a row per task, batch and field; the records are
    read once.
    """
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    readable = df.filter(F.col("rec").isNotNull())
    # one more cell per record counts the records
    leads = (F.col(order) == 0).alias("_leads")
    cells = readable.select(*BATCH, leads, F.explode(F.array_append(F.map_entries("rec"), none)).alias("_cell"))
    counted = cells.groupBy(*BATCH, F.col("_cell.key").alias("field")).agg(
        F.count(F.lit(1)).alias("present"),
        F.count(F.when(too_late(F.col("_cell.value")), True)).alias("late"),
        F.coalesce(F.max("_leads"), F.lit(False)).alias("leads"),
    )
    cell = F.struct("field", "present", "late")
    named = F.col("field").isNotNull()
    batches = counted.groupBy(*BATCH).agg(
        F.max(F.when(~named, F.col("present"))).alias("n"),
        F.sort_array(F.collect_list(F.when(named, cell))).alias("fields"),
        F.max("leads").alias("_first"),
        F.sort_array(F.collect_list(F.when(named & F.col("leads"), F.col("field")))).alias("_keys"),
    )
    batches = batches.withColumn("first_keys", F.when(F.col("_first"), F.col("_keys")))
    n = F.col("n")
    alive = F.filter("fields", lambda c: (n - c["present"]) / n <= missing_over)
    return batches.select(
        *BATCH, "n", "fields", "first_keys",
        F.md5(F.to_json(F.transform(alive, lambda c: c["field"]))).alias("layout"),
        F.exists("fields", lambda c: c["late"] / n > failed_over).alias("late"),
    )


def report_text(
    source: str, n: int, verdict: Verdict, mapping: FieldMapping, fields: list[str], first_keys: list[str],
    known_source: bool = True, error_samples: int = vocab.ERROR_SAMPLES,
) -> str:
    """The text of ``drift_report`` for one batch, from its signature."""
    unknown = next((t for t in mapping.values() if t not in vocab.TRANSFORMS), None)
    error = f"unknown_transform:{unknown}" if unknown else "created_at_range" if known_source else "source_unknown"
    listed = {
        "dead": verdict.dead, "unmapped": sorted(set(fields) - set(mapping)),
        "errors": [error] * min(verdict.failed, error_samples), "first": first_keys,
    }
    shown = {k: ", ".join(v) or "none" for k, v in listed.items()}
    pairs = ", ".join(f"{f}={t}" for f, t in mapping.items())
    return "\n".join(
        [
            f"mapping drift in source {source}",
            f"batch size: {n}, failing rows: {verdict.failed}",
            f"mapped fields missing from the data: {shown['dead']}",
            f"fields in the data but not mapped: {shown['unmapped']}",
            f"mapping: {pairs}",
            f"sample errors: {shown['errors']}",
            f"keys of the first record: {shown['first']}",
        ]
    )


def detect_drift(df: DataFrame, mappings: Mapping[str, FieldMapping], **options) -> DataFrame:
    """M4: the drifted batches."""
    return batch_health(df, mappings, **options).filter("drifted")


def drift_report(
    df: DataFrame,
    mappings: Mapping[str, FieldMapping],
    route: str = "source",
    order: str = "batch_pos",
    health: DataFrame | None = None,
    sources: tuple[str, ...] = vocab.SOURCES,
    error_samples: int = vocab.ERROR_SAMPLES,
) -> DataFrame:
    """M5: one row per drifted batch with the evidence, and as text."""
    if health is None:
        health = batch_health(df, mappings, route, sources)
    drifted = health.filter("drifted").select(*BATCH, "n", "failed", "dead_fields")
    # taken of all batches, a few values of each: rows do not move to meet the drifted ones
    unmapped = (
        unmapped_fields(df, mappings, route, order)
        .groupBy(*BATCH)
        .agg(F.sort_array(F.collect_list("field")).alias("unmapped"))
    )
    failing = df.filter(F.col("rec").isNotNull()).select(
        *BATCH, order, record_error(mappings, route, sources).alias("error")
    ).filter("error is not null")
    errors = (
        first_per_group(failing, list(BATCH), [order], error_samples)
        .groupBy(*BATCH)
        .agg(F.sort_array(F.collect_list(F.struct(order, "error"))).alias("_errors"))
        .select(*BATCH, F.transform("_errors", lambda e: e["error"]).alias("errors"))
    )
    first = df.filter(F.col(order) == 0).select(
        *BATCH, F.sort_array(F.map_keys("rec")).alias("first_keys"), F.col(route).alias("_route")
    )
    texts = {
        name: F.lit(", ".join(f"{f}={t}" for f, t in mapping.items()))
        for name, mapping in mappings.items()
    }
    nothing = F.array().cast("array<string>")

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("none"))

    joined = drifted
    for part in (unmapped, errors, first):
        joined = joined.join(part, list(BATCH), "left")
    return (
        joined.withColumns(
            {
                "unmapped": F.coalesce("unmapped", nothing),
                "errors": F.coalesce("errors", nothing),
                "first_keys": F.coalesce("first_keys", nothing),
                "mapping": _by_route(texts, "_route", F.lit("")),
            }
        )
        .drop("_route")
        .withColumn(
            "report",
            F.concat_ws(
                "\n",
                F.concat(F.lit("mapping drift in source "), "source"),
                F.concat(F.lit("batch size: "), "n", F.lit(", failing rows: "), "failed"),
                F.concat(F.lit("mapped fields missing from the data: "), listed("dead_fields")),
                F.concat(F.lit("fields in the data but not mapped: "), listed("unmapped")),
                F.concat(F.lit("mapping: "), "mapping"),
                F.concat(F.lit("sample errors: "), listed("errors")),
                F.concat(F.lit("keys of the first record: "), listed("first_keys")),
            ),
        )
    )
