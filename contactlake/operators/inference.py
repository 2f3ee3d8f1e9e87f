"""M7: infer a mapping from a profile.

Every (source, field) collects evidence for every transform: how the field is
called, what share of all its values the transform's own cleaner accepts,
and which transforms were approved for fields like it before. Fields and targets
are then assigned one to one, for the greatest sum of scores. Each further
attempt asks for less evidence, and what failed before is not proposed again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from contactlake import vocab
from contactlake.functions import dates, names, phones, text
from contactlake.functions.layers import apply_layers
from contactlake.operators.memory import similar_fields

#: words of a field name that speak for a transform
NAME_WORDS = {
    "split_full_name": ("name", "fullname"),
    "first_name": ("fname", "first", "firstname", "given", "forename"),
    "last_name": ("lname", "last", "lastname", "surname", "family"),
    "email": ("email", "mail", "emailaddress"),
    "phone": ("phone", "mobile", "cell", "tel", "telephone", "phonenumber", "whatsapp", "reach"),
    "campaign_id": ("campaign", "campaignid", "hear", "promo"),
    "consent": ("consent", "opt", "optin", "agree", "agreed", "permission", "subscribe"),
    "created_at": ("created", "submitted", "timestamp", "date", "time", "when"),
}
#: words that take a field out of the running (technical or attribution fields)
STOP_WORDS = ("uuid", "lead", "source", "medium", "ip", "agent", "referrer")
#: spellings of a refused consent
CONSENT_FALSE = ("no", "n", "false", "0", "disagree", "opt-out", "opted out", "")

WEIGHT_NAME, WEIGHT_VALUES, WEIGHT_MEMORY = 0.55, 0.35, 0.10
#: least score per attempt; the first asks for a telling name and fitting values
LEAST_SCORE = (0.55, 0.40, 0.30)
#: a candidate whose values mostly fail its cleaner is out
LEAST_FIT = 0.5
#: a remembered field less like this one says nothing
LEAST_SIMILAR = 0.6
REMEMBERED = "remembered"

Mapper = Callable[[DataFrame, DataFrame | None, int, DataFrame | None], DataFrame]


def _words(field: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(field, "([a-z])([A-Z])", "$1 $2"), "(?i)e-mail", "email")
    return F.array_remove(F.split(F.lower(spaced), "[^a-z0-9]+"), "")


#: what a value can be, as far as the cleaners accept it
KINDS = ("email", "phone", "created_at", "written_date", "consent", "name_like")


def judged(cells: DataFrame) -> DataFrame:
    """Rows with a column per kind: whether the cleaner of the kind accepts ``_value``.

    Every value is cleaned where it is. Cleaners that need a digit do not see
    values without one, and names are not looked for among values with digits
    or an at-sign; a value with characters beyond ASCII is shown to all.
    """
    v = F.col("_value")
    odd = ~text.is_ascii(v)
    digits = v.rlike("[0-9]")
    cleaned = apply_layers(
        cells.withColumns(
            {"_number": F.when(digits | odd, v), "_wordy": F.when(odd | ~v.rlike("[0-9@]"), F.nullif(v, F.lit("")))}
        ),
        phones.phone_recipe(F.col("_number"), "_phone"),
        dates.date_recipe(F.col("_number"), "_date"),
        names.name_recipe(F.col("_wordy"), "_name"),
    )
    consent = F.lower(text.strip(v)).isin(*vocab.CONSENT_TRUE, *CONSENT_FALSE)
    like = F.col("_name").rlike(r"^[\p{L}][\p{L}.'’ -]*$") | F.col("_name").isNull()
    return cleaned.select(
        *cells.columns,
        F.contains(v, F.lit("@")).alias("email"),  # no address is without
        (F.col("_phone").isNotNull() | ((F.col("_phone_flag") == phones.JUNK) & digits)).alias("phone"),
        F.col("_date").isNotNull().alias("created_at"),
        (F.col("_date").isNotNull() & v.rlike("[^0-9]")).alias("written_date"),
        (consent & (v != "")).alias("consent"),
        (F.col("_wordy").isNotNull() & like & ~consent).alias("name_like"),
    )


def with_remembered(profile: DataFrame, memory: DataFrame | None, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """The profile with a map: how far the memory speaks for each transform of a field.

    1 for a transform approved for an equally named field before; else the
    greatest similarity, from ``LEAST_SIMILAR`` on, of the approved fields most
    like this one, if the memory has vectors.
    """
    if memory is None:
        return profile.withColumn(REMEMBERED, F.create_map().cast("map<string,double>"))
    fields = profile.select(*keys, "field", F.lower("field").alias("_name"))
    named = memory.select(F.lower("field").alias("_name"), "transform").distinct()
    votes = fields.join(named, "_name").select(*keys, "field", "transform", F.lit(1.0).alias("_says"))
    if "vector" in memory.columns:
        near = similar_fields(memory, profile, keys=keys).filter(F.col("similarity") >= LEAST_SIMILAR)
        votes = votes.unionByName(
            near.select(*[F.col(f"for_{c}").alias(c) for c in (*keys, "field")], "transform", F.col("similarity").alias("_says"))
        )
    most = votes.groupBy(*keys, "field", "transform").agg(F.max("_says").alias("_says"))
    said = most.groupBy(*keys, "field").agg(F.map_from_entries(F.collect_list(F.struct("transform", "_says"))).alias(REMEMBERED))
    return profile.join(said, [*keys, "field"], "left").withColumn(
        REMEMBERED, F.coalesce(REMEMBERED, F.create_map().cast("map<string,double>"))
    )


def score_fields(
    profile: DataFrame, memory: DataFrame | None, keys: tuple[str, ...] = ("source",)
) -> DataFrame:
    """One row per field and transform it may have, with its score."""
    keys_ = list(keys)
    fit_of = {
        "email": F.col("evidence.email"),
        "phone": F.col("evidence.phone"),
        "created_at": F.col("evidence.created_at"),
        "consent": F.col("evidence.consent"),
        "split_full_name": F.col("evidence.name_like"),
        "first_name": F.col("evidence.name_like"),
        "last_name": F.col("evidence.name_like"),
        "campaign_id": F.lit(1.0),
    }
    #: how much a fitting value says without a telling name; a number that could be
    #: an epoch is rather a phone, a written date rather no phone
    telling = {
        "email": F.lit(1.0), "created_at": F.lit(0.87) + F.col("evidence.written_date") * 0.08, "phone": F.lit(0.9),
        "consent": F.lit(0.6),
    }
    if REMEMBERED not in profile.columns:
        profile = with_remembered(profile, memory, keys)
    described = profile.select(
        *keys_, "ordinal", "field", _words(F.col("field")).alias("_words"), "evidence", REMEMBERED
    )

    no_values = F.col("evidence").isNull()

    def option(transform: str) -> Column:
        named = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in NAME_WORDS[transform]]))
        if transform == "split_full_name":
            parts = NAME_WORDS["first_name"] + NAME_WORDS["last_name"]
            named = named & ~F.arrays_overlap("_words", F.array(*[F.lit(w) for w in parts]))
        if transform == "campaign_id":
            named = named & ~F.arrays_overlap("_words", F.array(F.lit("date"), F.lit("time")))
        fit = F.when(no_values, F.lit(1.0)).otherwise(fit_of[transform])
        remembered = F.coalesce(F.try_element_at(REMEMBERED, F.lit(transform)), F.lit(0.0))
        evidence_of_value = F.when(no_values, F.lit(0.0)).otherwise(
            F.when(named, fit).otherwise(fit * telling.get(transform, F.lit(0.0)))
        )
        return F.struct(
            F.lit(transform).alias("transform"),
            fit.alias("fit"),
            (
                named.cast("double") * WEIGHT_NAME
                + evidence_of_value * WEIGHT_VALUES
                + remembered * WEIGHT_MEMORY
            ).alias("score"),
        )

    stop = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in STOP_WORDS]))
    options = F.array(*[option(t) for t in NAME_WORDS])
    return (
        described.withColumn("_option", F.explode(options))
        .select(*keys_, "ordinal", "field", stop.alias("_stop"), "_option.*")
        .filter((F.col("fit") >= LEAST_FIT) & ~F.col("_stop"))
        .drop("_stop", "fit")
    )


def infer_mapping(
    profile: DataFrame,
    memory: DataFrame | None = None,
    attempt: int = 1,
    feedback: DataFrame | None = None,
    keys: tuple[str, ...] = ("source",),
) -> DataFrame:
    """A proposed mapping table for every profiled source.

    Each ``attempt`` asks for less evidence. ``feedback``, where it has the
    column ``failed``, lists per key the (field, transform) pairs that failed
    before, which are not proposed again; a null transform rules the field out.
    Fields without a transform are proposed as ``ignore``.
    """
    keys_ = list(keys)
    least = LEAST_SCORE[min(attempt, len(LEAST_SCORE)) - 1]
    scored = score_fields(profile, memory, keys).filter(F.col("score") >= least - 1e-9)
    if feedback is not None and "failed" in feedback.columns:
        failed = feedback.select(*keys_, F.explode("failed").alias("_f")).select(*keys_, "_f.*").distinct()
        never = failed.filter("transform IS NULL").select(*keys_, "field")
        scored = scored.join(never, [*keys_, "field"], "left_anti").join(
            failed.filter("transform IS NOT NULL"), [*keys_, "field", "transform"], "left_anti"
        )
    edges = scored.groupBy(*keys_).agg(F.sort_array(F.collect_list(F.struct("ordinal", "field", "transform", "score"))).alias("_edges"))
    chosen = edges.select(*keys_, F.explode(_assigned("_edges")).alias("_c")).select(*keys_, "_c.*")
    return (
        profile.select(*keys_, "ordinal", "field")
        .join(chosen, [*keys_, "field"], "left")
        .select(
            *keys_,
            "ordinal",
            "field",
            F.coalesce("transform", F.lit("ignore")).alias("transform"),
        )
    )


#: its proposals depend on nothing but the profile, the memory, the level of an attempt and the failed pairs
infer_mapping.repeats = True


def assign(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """The one-to-one choice of (field, transform) with the greatest sum of scores.

    Fields come in their order; of equal sums the choice wins that gives
    earlier fields earlier transforms. The best choices per set of transforms
    taken so far are carried from field to field.
    """
    order = list(NAME_WORDS)
    fields: dict[str, list[tuple[int, int]]] = {}
    for field, transform, score in edges:
        fields.setdefault(field, []).append((order.index(transform), round(score * 1_000_000)))
    best: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for place, options in enumerate(fields.values()):
        after = dict(best)
        for taken, (total, picks) in best.items():
            for rank, score in options:
                if taken >> rank & 1:
                    continue
                choice = (total - score, (*picks, (place, rank)))
                key = taken | 1 << rank
                if key not in after or choice < after[key]:
                    after[key] = choice
        best = after
    names = list(fields)
    return [(names[place], order[rank]) for place, rank in min(best.values())[1]]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("field", "transform")])))
def _assigned(edges: pd.Series) -> pd.Series:
    chosen = [assign([(e["field"], e["transform"], e["score"]) for e in key]) for key in edges]
    return pd.Series([[{"field": f, "transform": t} for f, t in picks] for picks in chosen])
