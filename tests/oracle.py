"""Comparing a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (bool, int, float)):
        return float(v)
    return str(v)[:10] if hasattr(v, "year") and str(v)[11:] in ("", "00:00:00") else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(map(_cell, r))) for r in df[columns].itertuples(index=False))


def assert_equal(query, sql, spark, sf_dir):
    ours, theirs = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).sql(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
    return len(ours[1])
