"""Quality rules: per-text counts, and lines that too many documents of a host share.

Everything is column expressions. The counts of a text never leave its row: the
word windows of a text are hashed into one array, and only texts with a
repeated window sort that array. Lines travel as hashes and word counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contactlake.operators.skew import attach_facts
from contactlake.session import Scratch

#: ASCII white space: U+0020 and U+0009 to U+000D
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 3
MIN_WORDS = 50
#: percent of the words that may stand in repeated windows
MAX_REPEATED = 50
#: a line may stand in so many documents of a host, however large the host is
MAX_LINE_DOCS = 30
#: share of a document's words that must be left when shared lines are gone
MIN_LEFT = 0.3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * (len(WHITE) - 1)), " "), "")


def _removed_count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def normalised_line(line: Column) -> Column:
    """Lower case, white space joined and cut at the ends, digits alike."""
    plain = F.translate(F.lower(line), WHITE[1:], " " * (len(WHITE) - 1))
    return F.trim(F.regexp_replace(F.translate(plain, "123456789", "000000000"), " {2,}", " "))


def _repeated_words(hashes: str, ordered: str) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes sorted with their places."""
    at = F.col(ordered)
    again = F.filter(
        at,
        lambda x, i: F.coalesce(F.get(at, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(at, i + 1)["h"] == x["h"], F.lit(False)),
    )
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    start = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        places, start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW_WORDS), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.col(ordered).isNotNull(), covered).otherwise(0).cast("bigint")


def text_counts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Per row its base counts and its lines ``(h, words)``; a null text is empty."""
    given = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    cut = given.withColumns(
        {
            "w": words(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda x: F.translate(x, WHITE, "") != ""),
        }
    )
    inner = F.greatest(F.size("w") - (WINDOW_WORDS - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("w", i + 1, inner).alias(f"w{i}") for i in range(WINDOW_WORDS)])
    hashed = cut.select(
        "key", "host",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("bigint").alias("word_chars"),
        _removed_count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(runs, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(WINDOW_WORDS)])).alias("hashes"),
        F.transform(
            "lines",
            lambda x: F.struct(F.xxhash64(normalised_line(x)).alias("h"), F.size(words(x)).alias("words")),
        ).alias("lines"),
    )
    placed = F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    sorted_ = hashed.withColumn(
        "ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(placed))
    )
    return sorted_.select(
        "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeated_words("hashes", "ordered").alias("n_repeat_words"), "lines",
    )


def line_quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = MAX_LINE_DOCS, min_left: float = MIN_LEFT,
) -> DataFrame:
    """Per row its counts, ``base_failed``, the words in removed lines, and ``kept``.

    A line is hashed in normalised form and counted once per row and host; a
    line in more than ``max_docs`` rows of a host is removed from that host's
    rows, whatever the host's size. A row is rejected if its base counts fail
    or less than ``min_left`` of its words is left. Null texts are empty and
    fail; a null host is the empty host; repeated rows count and stay; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    counted = text_counts(docs, key, text, host).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.put("counts", counted)  # the row numbers are stored, so all later jobs see the same
    distinct = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    in_rows = rows.select("host", F.explode(distinct).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    shared = scratch.put("shared", in_rows.filter(F.col("docs") > max_docs))
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    total = rows.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).head()[0]
    met = attach_facts(lines, shared, ["host", "h"], "docs", total)
    removed = met.groupBy("row").agg(F.sum("words").cast("bigint").alias("n_removed_words"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        rows.drop("lines").join(removed, "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
        .select(
            F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_removed_words", base_failed.alias("base_failed"),
            (~base_failed & (left >= min_left * F.col("n_words"))).alias("kept"),
        )
    )
