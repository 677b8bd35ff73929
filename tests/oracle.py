"""Holds a query's rows against those of its SQL in DuckDB."""

import math
import os

import duckdb


def normal(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())


def sql_rows(c, sql):
    r = c.sql(sql)
    columns = sorted(r.columns)
    at = [r.columns.index(x) for x in columns]
    return columns, sorted(tuple(normal(x[i]) for i in at) for x in r.fetchall())
