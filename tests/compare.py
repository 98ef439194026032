"""Compare a Spark result with DuckDB's, whatever the order of rows and columns."""

import glob
import os

import duckdb
import numpy as np


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6)
    return str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    frame = frame.where(frame.notna(), None)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame.values.tolist())


def assert_same(spark_df, con, sql):
    a, b = rows_of(spark_df.toPandas()), rows_of(con.sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
