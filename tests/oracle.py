"""Compare every query with its SQL over the same tables."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, (int, str)):
        return v
    return str(v)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, _sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], _sorted(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, sf_dir, query, sql) -> tuple[str, float]:
    """'' when equal, else what differs; and the seconds Spark took."""
    started = time.time()
    got_columns, got = spark_rows(query(spark, sf_dir))
    seconds = time.time() - started
    want_columns, want = sql_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", seconds
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: {got[:2]} / {want[:2]}", seconds
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}", seconds
    return "", seconds
