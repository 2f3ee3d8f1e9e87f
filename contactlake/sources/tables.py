"""K1-K5: the stored tables.

Plain Parquet folders. The leads table is a chain of versions, each a list of
immutable pieces; the side tables and the mapping log are appended by run, and a
repeated run replaces its own part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from contactlake import model
from contactlake.operators import mappings as M
from contactlake.operators.upsert import latest_by_key
from contactlake.session import Scratch
from contactlake.sources.feeds import exists

RUN = "run"
#: what the rows of a leads table are shuffled by
PLACE = ("bucket", "slice")


class RunTable:
    """An append-only table partitioned by run (K2, K3, K4).

    Writing a run again (a replayed micro-batch) replaces that run's rows and
    leaves all others alone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, df: DataFrame, run: str) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{RUN}={run}")

    def read(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(RUN, T.StringType())])
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)


@dataclass(frozen=True)
class Piece:
    """The rows of one bucket that one write put into one folder."""

    bucket: int
    folder: str
    rows: int


class LeadsTable:
    """The leads table with INSERT OR REPLACE by ``lead_id`` (K1) and marking by id.

    Rows are dealt into buckets by the hash of their id. A bucket is made of
    pieces, folders that are written once and never changed. A manifest lists
    the pieces of a version; the version is there when its manifest is. An
    insert adds a piece to the buckets of its rows and rewrites only those
    pieces that hold an id which it replaces; marking rewrites only pieces with
    a changed row. Buckets of more than ``MAX_PIECES`` pieces are joined on
    that occasion, and pieces that the last ``KEEP_VERSIONS`` versions do not
    list are deleted. There is one writer at a time. Rows are shuffled once per
    write; up to ``SLICES`` tasks share a bucket, so a large one is no burden.

    Frequent small loads (micro-batches) append to a ``RunTable`` instead and
    resolve the latest row per id when reading (``latest_by_key``).
    """

    ROWS_PER_BUCKET, MAX_BUCKETS = 2_000_000, 20_000
    MAX_PIECES, KEEP_VERSIONS = 8, 2
    SLICES = 8
    MANIFEST = "bucket int, folder string, rows bigint, buckets int"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), buckets

    # -- versions ------------------------------------------------------------

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/manifest/version=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/version={version}")

    def pieces(self) -> list[Piece]:
        """The pieces of the present version (a few per bucket)."""
        versions = self._versions()
        if not versions:
            return []
        return [Piece(r.bucket, r.folder, r.rows) for r in self._manifest(versions[-1]).filter("folder IS NOT NULL").collect()]

    def buckets(self) -> int | None:
        versions = self._versions()
        row = self._manifest(versions[-1]).select("buckets").head() if versions else None
        return row.buckets if row else None

    def _commit(self, version: int, pieces: list[Piece], buckets: int) -> None:
        rows = [(p.bucket, p.folder, p.rows, buckets) for p in pieces] or [(None, None, 0, buckets)]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/version={version}"
        )
        self._collect(pieces)

    def _collect(self, present: list[Piece]) -> None:
        """Delete what no kept version lists."""
        fs, path = self._fs()
        versions = self._versions()
        old, kept = versions[: -self.KEEP_VERSIONS], versions[-self.KEEP_VERSIONS :]
        if not old:
            return
        listed = {p.folder for p in present}
        for version in kept:
            listed |= {r.folder for r in self._manifest(version).select("folder").collect()}
        for version in old:
            for r in self._manifest(version).select("folder").collect():
                if r.folder is not None and r.folder not in listed:
                    fs.delete(path(f"{self.path}/data/{r.folder}"), True)
            fs.delete(path(f"{self.path}/manifest/version={version}"), True)

    # -- reading -------------------------------------------------------------

    def _rows(self, pieces: list[Piece]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], model.LEADS)
        return self.spark.read.schema(model.LEADS).parquet(*[f"{self.path}/data/{p.folder}" for p in pieces])

    def read(self) -> DataFrame:
        return self._rows(self.pieces())

    def _holding(self, pieces: list[Piece], ids: DataFrame) -> list[Piece]:
        """The pieces with a row of these ids; only the id column is read."""
        if not pieces:
            return []
        found = (
            self._rows(pieces).select("lead_id", self._folder()).join(ids.select("lead_id"), "lead_id", "left_semi")
            .select("folder").distinct().collect()
        )
        hit = {r.folder for r in found}
        return [p for p in pieces if p.folder in hit]

    # -- writing -------------------------------------------------------------

    def _folder(self) -> Column:
        """The folder of the piece a row was read from."""
        return F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -3), "/", 2).alias("folder")

    def _dealt(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Rows shuffled to where they are written: by ``PLACE``, a bucket and one of its slices."""
        bucket = F.pmod(F.xxhash64("lead_id"), F.lit(buckets)).cast("int")
        slice_ = F.pmod(F.hash("lead_id"), F.lit(self.SLICES)).cast("int")
        return rows.withColumns({"bucket": bucket, "slice": slice_}).repartition(*PLACE)

    def _write(self, dealt: DataFrame, name: str) -> list[Piece]:
        folder = f"{self.path}/data/{name}"
        rows = dealt.select(*model.LEADS.fieldNames(), "bucket")
        # both sides of a join with dealt rows keep their places
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
        finally:
            self.spark.conf.set(setting, before)
        if not exists(self.spark, f"{folder}/bucket=*"):
            return []
        written = self.spark.read.schema("bucket int").parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        return [Piece(r.bucket, f"{name}/bucket={r.bucket}", r.n) for r in written.collect()]

    def replace(self, leads: DataFrame) -> DataFrame:
        """Write a whole new version; the number of buckets follows its rows."""
        version = (self._versions() or [0])[-1] + 1
        buckets = self._wanted or min(self.MAX_BUCKETS, 1 + leads.count() // self.ROWS_PER_BUCKET)
        rows = model.conform(leads, model.LEADS)
        self._commit(version, self._write(self._dealt(rows, buckets), f"{version:09d}-all"), buckets)
        return self.read()

    def insert(self, leads: DataFrame) -> DataFrame:
        """Replace by id; of several new rows of one id the last in the feed counts."""
        ordered = ["ingested_at", "seq"] if "seq" in leads.columns else ["ingested_at"]
        pieces, buckets = self.pieces(), self.buckets()
        first = not buckets
        buckets = buckets or self._wanted or min(self.MAX_BUCKETS, 1 + leads.count() // self.ROWS_PER_BUCKET)
        version = (self._versions() or [0])[-1] + 1
        # the latest rows are found where they are written
        new = latest_by_key(self._dealt(leads, buckets), ["lead_id", *PLACE], ordered)
        rows = model.conform(new, T.StructType([*model.LEADS.fields, *[T.StructField(c, T.IntegerType()) for c in PLACE]]))
        added = self._write(rows, f"{version:09d}-{'all' if first else 'new'}")
        if first:
            self._commit(version, added, buckets)
            return self.read()
        touched = {p.bucket for p in added}
        ids = self._rows(added).select("lead_id")
        old = self._holding([p for p in pieces if p.bucket in touched], ids)
        return self._rewritten(version, pieces, old, added, buckets, self._without(ids, buckets))

    def _without(self, ids: DataFrame, buckets: int) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.join(self._dealt(ids, buckets), [*PLACE, "lead_id"], "left_anti")

    def mark(self, ids: DataFrame, status: str = "duplicate") -> DataFrame:
        """Give the leads of these ids another status; those that have it already are left alone."""
        pieces, buckets = self.pieces(), self.buckets()
        if not buckets:
            return self.read()
        other = self._rows(pieces).filter(~F.col("status").eqNullSafe(status)).select("lead_id", self._folder())
        changed = Scratch(self.spark, "marks").put("ids", other.join(ids.select("lead_id"), "lead_id", "left_semi"))
        folders = {r.folder for r in changed.select("folder").distinct().collect()}
        old = [p for p in pieces if p.folder in folders]
        hit = self._dealt(changed.select("lead_id"), buckets).withColumn("_hit", F.lit(True))

        def marked(df: DataFrame) -> DataFrame:
            new = F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))
            return df.join(hit, [*PLACE, "lead_id"], "left").withColumn("status", new).drop("_hit")

        return self._rewritten(self._versions()[-1] + 1, pieces, old, [], buckets, marked)

    def _rewritten(
        self, version: int, pieces: list[Piece], old: list[Piece], added: list[Piece], buckets: int,
        change: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """Commit a version in which ``old`` pieces are changed and others stay; crowded buckets are joined."""
        if not old and not added:
            return self.read()
        crowd = Counter(p.bucket for p in [*pieces, *added])
        touched = {p.bucket for p in [*old, *added]}
        old = [p for p in pieces if p in old or (p.bucket in touched and crowd[p.bucket] > self.MAX_PIECES)]
        changed = self._write(change(self._dealt(self._rows(old), buckets)), f"{version:09d}-old") if old else []
        self._commit(version, [p for p in pieces if p not in old] + changed + added, buckets)
        return self.read()


class MappingLog:
    """K4, M8: every approved or invalidated mapping, by run."""

    SCHEMA = T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("version", T.LongType()),
            T.StructField("state", T.StringType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("field", T.StringType()),
            T.StructField("transform", T.StringType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str):
        self.table = RunTable(spark, path, self.SCHEMA)
        self.spark = spark

    def write(self, df: DataFrame, run: str) -> None:
        self.table.write(df, run)

    def read(self, before_run: str | None = None) -> DataFrame:
        """The log; ``before_run`` hides that run and later ones, which is
        what a replay of the run must start from."""
        return _earlier(self.table.read(), before_run)

    def current(self, before_run: str | None = None) -> dict[str, dict[str, str]]:
        return M.from_table(M.current_mappings(self.read(before_run)))


class FieldMemory:
    """M9: the approved fields with their vectors, by run; the latest version of a field counts."""

    SCHEMA = T.StructType(
        [
            *[T.StructField(n, T.StringType()) for n in ("id", "source", "field", "transform", "doc")],
            T.StructField(
                "vector", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("dim", "n")]))
            ),
            T.StructField("version", T.LongType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str):
        self.table = RunTable(spark, path, self.SCHEMA)

    def write(self, df: DataFrame, run: str) -> None:
        self.table.write(df, run)

    def read(self, before_run: str | None = None) -> DataFrame:
        """One row per field; ``before_run`` hides that run and later ones."""
        return latest_by_key(_earlier(self.table.read(), before_run).drop(RUN), "id", "version")


def _earlier(table: DataFrame, before_run: str | None) -> DataFrame:
    """The rows of runs before one; runs are ordered as numbers are."""
    if before_run is None:
        return table
    width = max(64, len(before_run))  # "9" comes before "10"
    return table.filter(F.lpad(RUN, width, "0") < before_run.rjust(width, "0"))
