"""Feed files to ``(source, seq, raw_line, raw_payload, rec, file, block)``.

``seq`` numbers the records of one read: those of one piece (``block``) of a
file are consecutive. It stays the same when a task is retried, but not when
files are added. ``with_places`` gives what does: a record's place in its file,
from the landed table and without moving a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake.functions import text
from contactlake.operators import records
from contactlake.operators.positions import run_positions, with_position
from contactlake.session import Scratch, unsorted_write

JSON_LINES, CSV = "jsonl", "csv"
COLUMNS = ("source", "seq", "raw_line", "raw_payload", "rec", "file", "block")
#: what a record is known by, whatever else is read: files of a feed have different names
IDENTITY = ("source", "file", "place", "raw_line")


def origin() -> list[Column]:
    """The file a row was read from, and where the piece of it that a task read begins."""
    return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")]


def written(line: str) -> Column:
    """Whether a line is more than white space."""
    return text.strip(F.col(line)) != ""


def format_of(path: str) -> str:
    for fmt in (JSON_LINES, CSV):
        if path.endswith("." + fmt):
            return fmt
    raise ValueError(f"unsupported source file type: {path}")


def read_leads(
    spark: SparkSession, path: str, source: str, fmt: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Read one feed (a file, a folder or a pattern)."""
    fmt = fmt or format_of(path)
    if fmt == JSON_LINES:
        df = _read_json_lines(spark, path)
    elif fmt == CSV:
        df = _read_csv(spark, path, multi_line)
    else:
        raise ValueError(f"unsupported source format: {fmt}")
    return df.withColumn("source", F.lit(source)).select(*COLUMNS)


def _read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("raw_line"), *origin())
    # blank lines go first, so that those of a piece are numbered without gaps
    return json_records(lines.filter(written("raw_line")).withColumn("seq", F.monotonically_increasing_id()))


def json_records(lines: DataFrame) -> DataFrame:
    """Parse ``raw_line``; the payload of a flat line is the line itself,
    which keeps the JSON types of its values."""
    parsed = records.parse_lines(lines, "raw_line")
    flat = ~F.contains(F.col("raw_line"), F.lit('"entry"'))
    return parsed.withColumn(
        "raw_payload",
        F.when(flat & F.col("rec").isNotNull(), F.col("raw_line")).otherwise(
            records.payload_of(F.col("rec"))
        ),
    )


def _has_open_quote(lines: DataFrame) -> bool:
    """Whether some physical line ends inside a quoted field."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).limit(1).isEmpty()


def _read_csv(spark: SparkSession, path: str, multi_line: bool | None) -> DataFrame:
    """CSV with a header row.

    A quoted field may hold line breaks, and then files cannot be split. That
    is checked first (a scan that stops at the first such line), so ordinary
    exports of any size are read in parallel splits.
    """
    lines = spark.read.text(path)
    if multi_line is None:
        multi_line = _has_open_quote(lines)
    options = {"header": True, "escape": '"', "multiLine": multi_line, "enforceSchema": False}
    header = spark.read.options(**options).csv(path).columns
    corrupt = "_corrupt_record"
    schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in [*header, corrupt])
    rows = (
        spark.read.options(**options, columnNameOfCorruptRecord=corrupt, mode="PERMISSIVE")
        .schema(schema)
        .csv(path)
    )

    def quoted(name: str):
        return F.col(f"`{name.replace('`', '``')}`")

    # fields of a row that does not fit, quoted ones counted as one
    unquoted = F.regexp_replace(F.col(corrupt), '"(?:[^"]|"")*"', "")
    fields = F.char_length(unquoted) - F.char_length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    pairs = [x for name in header for x in (F.lit(name), quoted(name))]
    whole = F.create_map(*pairs).cast(records.RECORD)
    return rows.select(
        F.monotonically_increasing_id().alias("seq"),
        # a row with fewer fields than the header has NULL in the others; one with
        # more goes to review as it came
        F.when(F.col(corrupt).isNull() | (fields < len(header)), whole).alias("rec"),
        F.col(corrupt).alias("_bad"),
        records.payload_of(whole).alias("_whole"),
        *origin(),
    ).select(
        "seq",
        "file",
        "block",
        "rec",
        F.coalesce("_bad", "_whole").alias("raw_line"),
        F.when(F.col("rec").isNotNull(), F.col("_whole")).alias("raw_payload"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_all(
    spark: SparkSession, folder: str, files: Mapping[str, str], only: Iterable[str] | None = None
) -> DataFrame:
    """Every present feed of a folder, tagged and united."""
    wanted = set(only) if only is not None else set(files)
    feeds = {
        source: read_leads(spark, f"{folder}/{name}", source)
        for source, name in files.items()
        if source in wanted and exists(spark, f"{folder}/{name}")
    }
    return records.union_sources(feeds)


def land(df: DataFrame, path: str) -> DataFrame:
    """Write the parsed feed once, partitioned by source, and read it back.

    Later jobs see the same ``seq`` whatever the cluster size, and filters on
    the source prune folders. Rows keep the order in which they were read.
    """
    spark = df.sparkSession
    with unsorted_write(spark):
        df.write.mode("overwrite").partitionBy("source").parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def with_places(landed: DataFrame, scratch: Scratch) -> DataFrame:
    """A landed feed with ``pos`` (in its source, files by name) and ``place`` (in its file), both from 0.

    Places do not change when files are added or read in other pieces; a file
    that grows at its end keeps those of its lines.
    """
    outs = {"pos": ["source"], "place": ["source", "file"]}
    placed = run_positions(landed, ["file", "block"], "seq", outs, ["file", "block"], scratch)
    if placed is None:  # rows that were not numbered as they were read
        return with_position(with_position(landed, outs["pos"], out="pos"), outs["place"], out="place")
    return placed
