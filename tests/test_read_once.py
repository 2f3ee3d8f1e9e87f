"""Records are read once, and written without a sort of whole rows."""

from pyspark.sql import functions as F

from contactlake.operators import drift
from contactlake.session import Scratch
from contactlake.sources import feeds


def _records(spark):
    rows = [("a", 0, 0, {"x": "1", "y": None}), ("a", 0, 1, {"z": "2"}), ("b", 0, 0, None), ("b", 0, 1, {"x": "1"}), ("c", 0, 0, {})]
    schema = "source string, batch_id bigint, batch_pos bigint, rec map<string,string>"
    return Scratch(spark, "t").put("records", spark.createDataFrame(rows, schema))


def test_signatures_read_the_records_once(spark):
    found = drift.signatures(_records(spark))
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    told = {r.source: (r.n, [f.field for f in r.fields], r.first_keys) for r in found.collect()}
    assert told == {"a": (2, ["x", "y", "z"], ["x", "y"]), "b": (1, ["x"], None), "c": (1, [], [])}


def test_landed_rows_keep_the_order_in_which_they_were_read(spark, tmp_path):
    rows = [("s", seq, f"line {seq}") for seq in (3, 1, 2, 0)]
    landed = feeds.land(spark.createDataFrame(rows, "source string, seq bigint, raw_line string").coalesce(1), str(tmp_path / "landed"))
    assert [r.seq for r in landed.collect()] == [3, 1, 2, 0]


def test_more_partitions_than_open_files(spark):
    rows = spark.range(40).select((F.col("id") % 10).cast("int").alias("part"), "id").coalesce(1)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    stored = Scratch(spark, "t").put("parts", rows, ("part",))
    assert sorted((r.part, r.id) for r in stored.collect()) == sorted((i % 10, i) for i in range(40))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
