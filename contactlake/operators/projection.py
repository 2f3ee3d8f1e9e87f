"""Flat records to canonical leads.

The mapping decides which field feeds which target. It is compiled into
literal lookups on a route column (by default the source), so one projection
serves every source: the plan does not grow with the number of sources, and
rows are cleaned where they were read, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from contactlake import vocab
from contactlake.functions import dates, emails, names, phones, values
from contactlake.functions.layers import apply_layers
from contactlake.operators.positions import with_position
from contactlake.operators.records import parse_object, payload_of

FieldMapping = Mapping[str, str]

def _items(*columns: Column) -> Column:
    """Non-NULL texts as an array."""
    return F.array_compact(F.array(*columns))


@dataclass(frozen=True)
class Route:
    """What one mapping asks for, in mapping order.

    The last field of a target wins, even with a NULL; flags of all its
    e-mail and phone fields accumulate.
    """

    first: tuple[str, bool] | None
    last: tuple[str, bool] | None
    emails: tuple[str, ...]
    phones: tuple[str, ...]
    campaign: str | None
    consent: str | None
    created: str | None
    flag_order: tuple[tuple[str, int], ...]
    unknown: str | None

    @classmethod
    def of(cls, mapping: FieldMapping) -> Route:
        targets: dict[str, list[str]] = {}
        first = last = None
        order: list[tuple[str, int]] = []
        unknown = None
        for field, transform in mapping.items():
            if transform not in vocab.TRANSFORMS:
                unknown = unknown or transform
                continue
            seen = targets.setdefault(transform, [])
            if transform in ("email", "phone"):
                order.append((transform, len(seen)))
            seen.append(field)
            if transform in ("split_full_name", "first_name"):
                first = (field, transform == "split_full_name")
            if transform in ("split_full_name", "last_name"):
                last = (field, transform == "split_full_name")

        def final(transform: str) -> str | None:
            return targets.get(transform, [None])[-1]

        return cls(
            first=first,
            last=last,
            emails=tuple(targets.get("email", ())),
            phones=tuple(targets.get("phone", ())),
            campaign=final("campaign_id"),
            consent=final("consent"),
            created=final("created_at"),
            flag_order=tuple(order),
            unknown=unknown,
        )


class _Lookup:
    """Per-route literals as one column."""

    def __init__(self, routes: dict[str, Route], key: Column):
        self.routes, self.key = routes, key

    def __call__(self, pick) -> Column:
        chosen = {name: pick(route) for name, route in self.routes.items()}
        chosen = {name: value for name, value in chosen.items() if value is not None}
        if not chosen:
            return F.lit(None)
        literals = [F.lit(x) for pair in chosen.items() for x in pair]
        return F.try_element_at(F.create_map(*literals), self.key)


def _at(items: Sequence[str], i: int) -> str | None:
    return items[i] if i < len(items) else None


def lead_id(*identity: Column) -> Column:
    """A stable id of uuid shape from the identity columns."""
    digest = F.sha2(F.concat_ws("|", *identity), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def canonicalize(
    df: DataFrame,
    mappings: Mapping[str, FieldMapping],
    ingest_ts: Column,
    route: str = "source",
    identity: tuple[str, ...] = ("source", "seq", "raw_line"),
    keep: tuple[str, ...] = (),
    sources: Sequence[str] = vocab.SOURCES,
) -> DataFrame:
    """Clean, flag, score and check every record; nothing is dropped.

    ``df`` needs ``source``, ``rec`` and the identity columns, and may bring
    ``raw_payload``. The result has the canonical columns plus ``raw_line``,
    the ``keep`` columns and ``violations`` (P17); see ``split_valid``.
    ``sources`` are the names the contract accepts.

    The default identity is the record's place and text in its source. It
    needs no shuffle; use ``with_occurrence`` and identity ``("source",
    "raw_line", "occurrence_no")`` where places are not stable.
    """
    routes = {name: Route.of(mapping) for name, mapping in mappings.items()}
    pick = _Lookup(routes, F.col(route))
    n_emails = max((len(r.emails) for r in routes.values()), default=0)
    n_phones = max((len(r.phones) for r in routes.values()), default=0)

    def field(choose) -> Column:
        return F.try_element_at(F.col("rec"), pick(choose).cast("string"))

    has_payload = "raw_payload" in df.columns
    raw: dict[str, Column] = {
        "_first_raw": field(lambda r: r.first and r.first[0]),
        # a full-name field feeds both parts and is cleaned once
        "_last_raw": field(lambda r: None if r.last is None or r.last == r.first else r.last[0]),
        "_created_raw": field(lambda r: r.created),
        "_shared": F.coalesce(
            pick(lambda r: True if r.first and r.first == r.last else None), F.lit(False)
        ),
        "_first_split": F.coalesce(
            pick(lambda r: True if r.first and r.first[1] else None), F.lit(False)
        ),
        "_last_split": F.coalesce(
            pick(lambda r: True if r.last and r.last[1] else None), F.lit(False)
        ),
        "campaign_id": values.campaign(field(lambda r: r.campaign)),
        "consent": values.consent(field(lambda r: r.consent)),
        "raw_payload": F.coalesce(F.col("raw_payload"), payload_of(F.col("rec")))
        if has_payload
        else payload_of(F.col("rec")),
        "lead_id": lead_id(*[F.col(c).cast("string") for c in identity]),
    }
    for i in range(n_emails):
        raw[f"_email_raw{i}"] = field(lambda r, i=i: _at(r.emails, i))
    for i in range(n_phones):
        raw[f"_phone_raw{i}"] = field(lambda r, i=i: _at(r.phones, i))

    kept = list(dict.fromkeys(["source", "raw_line", *keep, *([route] if route != "source" else [])]))
    picked = df.select(
        *[c for c in kept if c in df.columns and c not in raw],
        F.col("rec").isNull().alias("_unreadable"),
        *[c.alias(name) for name, c in raw.items()],
    )
    recipes = [
        (
            names.name_recipe(F.col("_first_raw"), "_first"),
            names.name_recipe(F.col("_last_raw"), "_last"),
        ),
        dates.date_recipe(F.col("_created_raw"), "_created"),
    ]
    recipes += [emails.email_recipe(F.col(f"_email_raw{i}"), f"_email{i}") for i in range(n_emails)]
    recipes += [phones.phone_recipe(F.col(f"_phone_raw{i}"), f"_phone{i}") for i in range(n_phones)]
    cleaned = apply_layers(picked, *recipes)

    # Presence of the i-th e-mail or phone field: an unmapped one sets no flag.
    def mapped(kind: str, i: int) -> Column:
        return F.coalesce(
            pick(lambda r: True if i < len(getattr(r, kind)) else None), F.lit(False)
        )

    mapped_columns = {
        **{f"_has_email{i}": mapped("emails", i) for i in range(n_emails)},
        **{f"_has_phone{i}": mapped("phones", i) for i in range(n_phones)},
    }
    cleaned = cleaned.withColumns(mapped_columns) if mapped_columns else cleaned

    def last_of(kind: str, n: int) -> Column:
        value = F.lit(None).cast("string")
        for i in range(n):
            value = F.when(F.col(f"_has_{kind}{i}"), F.col(f"_{kind}{i}")).otherwise(value)
        return value

    def flag(kind: str, i: int, suffix: str) -> Column:
        return F.when(F.col(f"_has_{kind}{i}"), F.col(f"_{kind}{i}_{suffix}"))

    def any_flag(columns: list[Column]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(c, F.lit(False))
        return out

    email_hard = [flag("email", i, "flag") for i in range(n_emails)]
    phone_flags = [flag("phone", i, "flag") for i in range(n_phones)]
    first = F.when(F.col("_first_split"), names.first_word(F.col("_first_words"))).otherwise(
        F.col("_first")
    )
    last = F.when(F.col("_last_split"), names.other_words(F.col("_last_words"))).otherwise(
        F.col("_last")
    )
    worded = cleaned.withColumn(
        "_first_words", F.when(F.col("_first_split"), names.spaced(F.col("_first")))
    ).withColumn(
        "_last_words",
        F.when(F.col("_shared"), F.col("_first_words")).when(
            F.col("_last_split"), names.spaced(F.col("_last"))
        ),
    )
    valued = worded.withColumns(
        {
            "first_name": first,
            "last_name": last,
            "email": last_of("email", n_emails),
            "phone_e164": last_of("phone", n_phones),
            "created_at": F.coalesce(F.col("_created"), ingest_ts),
            "_email_junk": any_flag([f == emails.JUNK for f in email_hard]),
            "_unverified": any_flag([f == phones.UNVERIFIED for f in phone_flags]),
            "_hard": any_flag([f.isNotNull() for f in email_hard])
            | any_flag([f != phones.UNVERIFIED for f in phone_flags]),
        }
    ).withColumns(
        {
            "_no_date": F.when(
                F.col("_created").isNull() & ~F.col("_created_overflow"), F.lit("date_missing")
            ),
            "_no_name": F.when(
                F.col("first_name").isNull() & F.col("last_name").isNull(), F.lit("name_missing")
            ),
        }
    )

    # Flags in mapping order; routes share the few distinct orders.
    by_order: dict[tuple, list[str]] = {}
    for name, r in routes.items():
        by_order.setdefault(r.flag_order, []).append(name)

    def ordered_flags(order: tuple[tuple[str, int], ...]) -> Column:
        parts: list[Column] = []
        for kind, i in order:
            if kind == "email":
                parts.append(F.col(f"_email{i}_typo"))
            parts.append(F.col(f"_{kind}{i}_flag"))
        return _items(*parts, F.col("_no_date"), F.col("_no_name"))

    flags = ordered_flags(())
    for order, members in by_order.items():
        flags = F.when(F.col(route).isin(*members), ordered_flags(order)).otherwise(flags)

    unknown = pick(lambda r: r.unknown)
    scored = valued.withColumns(
        {
            "flags": flags,
            "status": F.when(
                F.col("_hard") | F.col("_no_date").isNotNull() | F.col("_no_name").isNotNull(),
                F.lit("flagged"),
            ).otherwise(F.lit("clean")),
            "quality_score": values.quality_score(
                F.col("phone_e164"),
                F.col("_unverified"),
                F.col("email"),
                F.col("_email_junk"),
                F.col("consent"),
                F.col("first_name"),
                F.col("last_name"),
                F.col("campaign_id"),
            ),
            "ingested_at": ingest_ts,
            "_unknown": F.concat(F.lit("unknown_transform:"), unknown.cast("string")),
        }
    )
    checked = scored.withColumn(
        "violations",
        F.when(F.col("_unreadable"), F.array(F.lit("unreadable_record")))
        .when(~F.coalesce(F.col(route).isin(*routes), F.lit(False)), F.array(F.lit("no_mapping")))
        .otherwise(
            _items(
                F.col("_unknown"),
                F.when(F.col("_created_overflow"), F.lit("created_at_range")),
                *contract_violations(sources),
            )
        ),
    )
    extra = [c for c in kept if c not in ("source",)]
    # The row counter also keeps filters on the results above this point:
    # pushed down, they would be rewritten in terms of the raw fields and
    # repeat the whole cleaning inside the predicate.
    return checked.observe(f"canonicalized-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows")).select(
        "lead_id", "first_name", "last_name", "email", "phone_e164", "source", "campaign_id",
        "consent", "created_at", "quality_score", "status", "flags", "raw_payload", "ingested_at",
        *[c for c in extra if c in checked.columns], "violations",
    )


def contract_violations(sources: Sequence[str] = vocab.SOURCES) -> list[Column]:
    """Names of the broken rules of a canonical row, NULL where kept."""
    return [
        F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), F.lit("source_unknown")),
        F.when(F.col("created_at").isNull(), F.lit("created_at_missing")),
        F.when(
            F.col("phone_e164").isNotNull() & ~F.col("phone_e164").rlike(r"^\+[0-9]{7,15}$"),
            F.lit("phone_not_e164"),
        ),
        F.when(
            ~F.coalesce(F.col("quality_score").between(0, 100), F.lit(False)), F.lit("score_range")
        ),
        F.when(~F.coalesce(F.col("status").isin(*vocab.STATUSES), F.lit(False)), F.lit("status_unknown")),
    ]


def payload_violation() -> Column:
    """The JSON rule of P17. ``canonicalize`` does not need it: its payload is
    either rendered from the record or the text the record was parsed from."""
    payload = F.col("raw_payload")
    is_json = F.try_parse_json(payload).isNotNull() | parse_object(payload).isNotNull()
    return F.when(~is_json, F.lit("payload_not_json"))


def check_contract(df: DataFrame, sources: Sequence[str] = vocab.SOURCES) -> DataFrame:
    """P17 on a canonical table from elsewhere."""
    return df.withColumn("violations", _items(*contract_violations(sources), payload_violation()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and rows that break it."""
    ok = F.size("violations") == 0
    return df.filter(ok).drop("violations"), df.filter(~ok)


def with_occurrence(df: DataFrame, keys: tuple[str, ...] = ("source", "raw_line"), order: str = "seq") -> DataFrame:
    """Number equal lines of a source (0, 1, ...) for a content-based id.

    A line repeated any number of times is numbered in ranges of ``order``,
    so even a feed that is mostly copies of one line spreads over tasks.
    """
    digest = "_line_digest"
    hashed = df.withColumn(digest, F.sha2(F.concat_ws("|", *[F.col(k) for k in keys]), 256))
    return with_position(hashed, [digest], order, "occurrence_no").drop(digest)
