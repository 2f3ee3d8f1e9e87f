"""Raw lines to flat records.

A flat record is a ``map<string,string>`` column: a key that is absent and a
key whose value is null stay different things, which the drift test needs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from contactlake.functions import text

RECORD = T.MapType(T.StringType(), T.StringType(), True)

_TEXT = T.StringType()
_FIELD_DATA = T.ArrayType(
    T.StructType([T.StructField("name", _TEXT), T.StructField("values", T.ArrayType(_TEXT))])
)
#: ``entry[].changes[].value``; the value stays a map, so a key that is
#: absent and one that is null can be told apart
_ENTRIES = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "changes", T.ArrayType(T.StructType([T.StructField("value", RECORD)]))
            )
        ]
    )
)
_STRICT = {"allowSingleQuotes": "false"}

#: keys of the webhook value that become fields of their own
WEBHOOK_KEYS = ("campaign_id", "created_time")


def parse_object(line: Column) -> Column:
    """A JSON object as a flat record; NULL when the text is not one.

    A key given twice keeps its last value (the session's LAST_WIN policy).
    """
    return F.map_concat(F.from_json(line, RECORD, _STRICT), F.create_map().cast(RECORD))


def webhook_entries(flat: Column) -> Column:
    """The ``entry`` array of a parsed webhook line."""
    return F.from_json(F.try_element_at(flat, F.lit("entry")), _ENTRIES)


def webhook_record(value: Column) -> Column:
    """Flatten one webhook ``value``: its own keys, then its field data.

    A later item overwrites an earlier one of the same name (LAST_WIN). An
    item without a name gets the key ``""``, one without values a present key
    holding NULL. NULL value, NULL record.
    """
    own = [
        F.when(
            F.map_contains_key(value, key), F.create_map(F.lit(key), F.try_element_at(value, F.lit(key)))
        ).otherwise(F.create_map().cast(RECORD))
        for key in WEBHOOK_KEYS
    ]
    field_data = F.from_json(F.try_element_at(value, F.lit("field_data")), _FIELD_DATA)
    items = F.map_from_entries(
        F.transform(
            F.coalesce(field_data, F.array().cast(_FIELD_DATA)),
            lambda item: F.struct(
                F.coalesce(item["name"], F.lit("")), F.get(item["values"], F.lit(0))
            ),
        )
    )
    return F.when(value.isNotNull(), F.map_concat(*own, items))


def first_change(entries: Column) -> Column:
    """The ``value`` of the first change of the first entry."""
    return F.get(F.get(entries, F.lit(0))["changes"], F.lit(0))["value"]


def is_webhook(flat: Column) -> Column:
    return F.coalesce(F.map_contains_key(flat, "entry"), F.lit(False))


def with_record(df: DataFrame, line: str, out: str = "rec") -> DataFrame:
    """One JSON line of either shape to a flat record (S1 with S3).

    An object with the key ``entry`` is a webhook payload. Text that is not a
    JSON object, and a webhook without a first change, give NULL.
    """
    flat, value = "_flat", "_value"
    parsed = df.withColumn(flat, parse_object(F.col(line)))
    valued = parsed.withColumn(
        value, F.when(is_webhook(F.col(flat)), first_change(webhook_entries(F.col(flat))))
    )
    return valued.withColumn(
        out, F.when(is_webhook(F.col(flat)), webhook_record(F.col(value))).otherwise(F.col(flat))
    ).drop(flat, value)


def parse_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Drop blank lines and parse the rest into ``rec``."""
    return with_record(df.filter(text.strip(F.col(line)) != ""), line)


def flatten_all_changes(df: DataFrame, line: str = "value") -> DataFrame:
    """One record per change of every entry, not only the first.

    A line that is no webhook, or one without changes, still gives one row
    (its flat record, or a NULL record for review).
    """
    flat = df.withColumn("_flat", parse_object(F.col(line)))
    entries = flat.select(
        "*",
        F.posexplode_outer(F.when(is_webhook(F.col("_flat")), webhook_entries(F.col("_flat")))).alias(
            "entry_no", "_entry"
        ),
    )
    values = entries.select("*", F.posexplode_outer("_entry.changes").alias("change_no", "_change"))
    return values.withColumn(
        "rec",
        F.when(is_webhook(F.col("_flat")), webhook_record(F.col("_change.value"))).otherwise(
            F.col("_flat")
        ),
    ).drop("_flat", "_entry", "_change")


def csv_record(line: Column, header: list[str]) -> Column:
    """One CSV line with known header names as a flat record."""
    schema = ", ".join(f"c{i} STRING" for i in range(len(header)))
    row = F.from_csv(line, schema, {"escape": '"'})
    pairs = [x for i, name in enumerate(header) for x in (F.lit(name), row[f"c{i}"])]
    return F.create_map(*pairs)


def payload_of(rec: Column) -> Column:
    """The flat record as JSON text."""
    return F.to_json(rec)


def union_sources(feeds: Mapping[str, DataFrame], only: Iterable[str] | None = None) -> DataFrame:
    """Tag each feed with its source and union them; ``only`` subsets."""
    wanted = set(only) if only is not None else set(feeds)
    tagged = [df.withColumn("source", F.lit(name)) for name, df in feeds.items() if name in wanted]
    if not tagged:
        raise ValueError("no source selected")
    return reduce(DataFrame.unionByName, tagged)


def rename_fields(rec: Column, renames: Mapping[str, str]) -> Column:
    """K6 on flat records: rename keys, others unchanged."""
    table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    return F.transform_keys(rec, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def rename_webhook_fields(line: Column, renames: Mapping[str, str]) -> Column:
    """K6 on webhook lines: rename the field names of the first change of the first entry.

    Only the names between that change's field data and the next one's are
    touched, so every other part of the line stays as it came; a first change
    without field data leaves the line alone.
    """
    mark = '"field_data"'
    head, upto = (F.substring_index(line, mark, n) for n in (1, 2))
    body = F.substring(upto, F.char_length(head) + 1, F.char_length(line))
    tail = F.substring(line, F.char_length(upto) + 1, F.char_length(line))
    for old, new in renames.items():
        name, other = (json.dumps(x, ensure_ascii=False) for x in (old, new))
        other = re.sub(r"([\\$])", r"\\\1", other)
        body = F.regexp_replace(body, F.lit(rf'("name"\s*:\s*){re.escape(name)}'), F.lit(f"$1{other}"))
    first = F.get_json_object(line, "$.entry[0].changes[0].value.field_data")
    return F.when(first.isNotNull(), F.concat(head, body, tail)).otherwise(line)
