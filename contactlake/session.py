"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings every operator relies on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Methods above this size are never compiled to machine code by the JVM;
    # wide cleaning projections fall back to split code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "contactlake", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the folder the cluster names in ``spark.checkpoint.dir``; only a
    local session without one (a test) gets a temporary folder. Elsewhere each
    machine would write to a folder of its own, so the job stops instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="contactlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: files that one task of a partitioned write holds open; beyond them Spark sorts its rows by partition
OPEN_FILES = 4


@contextmanager
def unsorted_write(spark: SparkSession) -> Iterator[None]:
    """Partitioned writes in here put rows where they belong as they come, without a sort of whole rows."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Written intermediate tables of one job, under the shared folder.

    ``put`` writes a frame as Parquet and returns the table read back: lineage
    is cut, a lost executor costs a re-read instead of a recompute, and the
    next plan sees real sizes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = self.path(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with unsorted_write(df.sparkSession):
            writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one superseded table; without a name all of them, once the results are written."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        conf = self.spark._jsc.hadoopConfiguration()
        jvm_path.getFileSystem(conf).delete(jvm_path, True)
