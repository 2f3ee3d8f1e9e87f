"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect
from workload import queries as workload

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert not QUERIES[name](spark, SF).isEmpty()
        return
    difference, _ = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert difference == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r.source for r in rows] == ["facebook", "google_form", "instagram", "landing_page"]
    assert all(r.clean > 0 and r.flagged > 0 for r in rows)


def test_leads_are_cleaned_without_a_copy_of_the_feed(spark, tmp_path):
    orders = spark.range(40).selectExpr("id as o_orderkey", "timestamp'2026-01-01 10:00:00' as o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = workload.leads(spark, str(tmp_path))
    assert found.count() > 0
    assert not any(key[1] == str(tmp_path) and key[2].startswith("raw") for key in workload._STORED)
