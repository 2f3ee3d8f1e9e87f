"""Dates to UTC timestamps.

The text is recognised by shape, rearranged to ISO order and cast once; no
row runs through a list of failing format parsers. Incomplete dates ("July",
"10") give NULL, because filling them needs today's date; two-digit years are
placed by a pivot.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contactlake.functions import text
from contactlake.functions.layers import Recipe

EPOCH = r"^[0-9]{9,13}$"
#: larger epochs count milliseconds
MILLIS_ABOVE = 10**12
#: first second of the year 10000: such a row fails its contract
LAST_SECOND = 253402300799
#: two-digit years below this are of this century, the others of the last one
PIVOT = 70

# Month names are recognised by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"
_WEEKDAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,?\\s+)?"
_TAIL = r"(?:[t,\s]+(.*))?$"
YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}"
OVER_TWELVE = r"^(?:1[3-9]|[2-9]\d)"
MONTH_FIRST = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TAIL}"
DAY_NAME_YEAR = rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[-/\s]*{_MONTH}[-/,\s]*(\d{{4}}|\d{{2}}){_TAIL}"
NAME_DAY_YEAR = rf"^{_WEEKDAY}{_MONTH}[-/\s]*(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{4}}|\d{{2}}){_TAIL}"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{6}.*))?$"
COMPACT_CLOCK = r"^(\d{2})(\d{2})(\d{2})(\D.*)?$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
HALF_DAY = r"^(\d{1,2})(?::(\d{2})(?::(\d{2}))?)?\s*([ap])\.?m\.?\s*(z|[+-]\d{1,2}(?::?\d{2})?)?$"
#: a clock before the date, or between month and year, is moved behind it
CLOCK_FIRST = r"^(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:\s*[ap]\.?m\.?)?)[,\s]+(.*\d.*)$"
CLOCK_INSIDE = rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}})\s+(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)(\s+[a-z]{{1,5}})?\s+(\d{{4}})$"
#: a zone name after the clock: those of UTC count, others say nothing a parser without a table of them could use
UTC_NAME = r"\s*\b(?:utc|gmt)$"
OTHER_NAME = r"([0-9m.])\s+(?![ap]\.?m)[a-z]{3,5}$"
FULL_DAY = rf"^{_CLOCK}\s*(z|utc|gmt|[+-]\d{{1,2}}(?::?\d{{2}})?)?$"


def date_recipe(raw: Column, out: str, pivot: int = PIVOT) -> Recipe:
    """Columns ``out`` and ``{out}_overflow`` (epoch beyond the year 9999)."""
    whole, s, epoch, shape, iso, day, clock, stamp = (
        f"_{out}_{step}"
        for step in ("whole", "s", "epoch", "shape", "iso", "day", "clock", "stamp")
    )
    S, SHAPE, ISO, DAY, CLOCK = (F.col(c) for c in (s, shape, iso, day, clock))

    def separated(place: int) -> Column:
        return F.substring(S, place, 1).isin("-", "/", ".")

    def arranged(pattern: str, order: str) -> Column:
        return F.regexp_replace(S, pattern, order)

    def by_month_name(pattern: str, year: int, month: int, date: int, tail: int) -> Column:
        place = F.position(F.regexp_extract(S, pattern, month), F.lit(MONTHS))
        number = (place + F.lit(2)) / F.lit(3)
        return F.concat(
            F.regexp_extract(S, pattern, year),
            F.lit("-"),
            number.cast("int").cast("string"),
            F.lit("-"),
            F.regexp_extract(S, pattern, date),
            F.lit("|"),
            F.regexp_extract(S, pattern, tail),
        )

    seconds = F.when(F.col(epoch) > MILLIS_ABOVE, F.floor(F.col(epoch) / 1000)).otherwise(F.col(epoch))
    hour = F.regexp_extract(CLOCK, HALF_DAY, 1).cast("int")
    hour24 = hour % 12 + F.when(F.regexp_extract(CLOCK, HALF_DAY, 4) == "p", 12).otherwise(0)
    minute, second = (F.regexp_extract(CLOCK, HALF_DAY, i) for i in (2, 3))
    half_day = F.when(
        hour <= 12,
        F.concat(
            hour24.cast("string"),
            F.lit(":"),
            F.when(minute != "", minute).otherwise(F.lit("00")),
            F.lit(":"),
            F.when(second != "", second).otherwise(F.lit("00")),
            F.upper(F.regexp_extract(CLOCK, HALF_DAY, 5)),
        ),
    )
    full_day = F.upper(F.replace(F.regexp_replace(CLOCK, r"\s*(?:utc|gmt)$", "z"), F.lit(","), F.lit(".")))
    return Recipe(
        # full-width digits and separators become ASCII ones
        compose={whole: text.compose(raw, compat=True)},
        layers=[
            {s: F.lower(text.strip(F.col(whole)))},
            {
                s: F.when(S.rlike(CLOCK_FIRST), F.regexp_replace(S, CLOCK_FIRST, "$2 $1"))
                .when(S.rlike(CLOCK_INSIDE), F.regexp_replace(S, CLOCK_INSIDE, "$1 $2 $5 $3$4"))
                .when(S.rlike(r"\d,?\s+at\s+\d"), F.regexp_replace(S, r",?\s+at\s+", " "))
                .otherwise(S)
            },
            {
                epoch: F.when(F.char_length(S).between(9, 13) & S.rlike(EPOCH), S.cast("bigint")),
                shape: F.when(separated(5) & S.rlike(YEAR_FIRST), F.lit("year_first"))
                .when((separated(3) | separated(2)) & S.rlike(MONTH_FIRST), F.lit("month_first"))
                .when(S.rlike(DAY_NAME_YEAR), F.lit("day_name_year"))
                .when(S.rlike(NAME_DAY_YEAR), F.lit("name_day_year"))
                .when(S.rlike(COMPACT), F.lit("compact")),
            },
            {
                iso: F.when(F.col(epoch).isNotNull(), F.lit(None))
                .when(SHAPE == "year_first", arranged(YEAR_FIRST, "$1-$2-$3|$4"))
                .when(
                    SHAPE == "month_first",
                    F.when(S.rlike(OVER_TWELVE), arranged(MONTH_FIRST, "$3-$2-$1|$4")).otherwise(
                        arranged(MONTH_FIRST, "$3-$1-$2|$4")
                    ),
                )
                .when(SHAPE == "day_name_year", by_month_name(DAY_NAME_YEAR, 3, 2, 1, 4))
                .when(SHAPE == "name_day_year", by_month_name(NAME_DAY_YEAR, 3, 1, 2, 4))
                .when(SHAPE == "compact", arranged(COMPACT, "$1-$2-$3|$4"))
            },
            {
                day: F.when(
                    ISO.rlike("^[0-9]{2}-"),
                    F.concat(F.when(F.substring(ISO, 1, 2).cast("int") < pivot, "20").otherwise("19"), F.substring_index(ISO, "|", 1)),
                ).otherwise(F.substring_index(ISO, "|", 1)),
                clock: F.when(
                    SHAPE == "compact",
                    F.regexp_replace(F.substring_index(ISO, "|", -1), COMPACT_CLOCK, "$1:$2:$3$4"),
                ).otherwise(F.substring_index(ISO, "|", -1)),
            },
            {clock: F.regexp_replace(F.regexp_replace(CLOCK, UTC_NAME, "z"), OTHER_NAME, "$1")},
            {
                stamp: F.when(CLOCK == "", DAY)
                .when(CLOCK.rlike(FULL_DAY), F.concat(DAY, F.lit(" "), full_day))
                .when(CLOCK.rlike(HALF_DAY), F.concat(DAY, F.lit(" "), half_day))
            },
            {
                out: F.when(
                    F.col(epoch).isNotNull(),
                    F.when(seconds <= LAST_SECOND, F.timestamp_seconds(seconds)),
                ).otherwise(F.col(stamp).try_cast("timestamp")),
                f"{out}_overflow": F.coalesce(seconds > LAST_SECOND, F.lit(False)),
            },
        ]
    )
