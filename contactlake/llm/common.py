"""What the corpus operators share: session settings, inputs, names."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import contactlake
from contactlake.session import configure

#: rows and bytes that a Python worker holds at once; texts may be long
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python the package, once per application; Spark serves the file to them."""
    context = spark.sparkContext
    if getattr(context, "_contactlake_shipped", False):
        return
    root = Path(contactlake.__file__).parent
    target = f"{tempfile.mkdtemp(prefix='contactlake-')}/contactlake.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(target)
    context._contactlake_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the library's settings, ship the package, and bound the batches sent to Python."""
    ship(spark)
    for key, value in ARROW_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: str) -> Column:
    """The text's bytes; a null text is the empty one."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")
