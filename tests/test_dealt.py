"""Work that follows the cores, not the layout of the files."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from workload import feed


def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    n = 4 * feed.ROWS_PER_TASK
    day = datetime.datetime(2020, 1, 1)
    orders = pa.table({"o_orderkey": pa.array([*range(n)], pa.int64()), "o_orderdate": pa.array([day] * n, pa.timestamp("us"))})
    pq.write_table(orders, tmp_path / "orders.parquet")
    rows = feed.raw_columns(spark, str(tmp_path)).select("seq", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.seq for r in rows) == [*range(n)]
    assert len({r.task for r in rows}) == 4
