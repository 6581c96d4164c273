"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def tables(root):
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 4)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in values)


def compare(spark, con, root, query, sql):
    df = query(spark, root)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    return rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
