"""Runs a query and its SQL over the same tables and compares all rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    c = sorted(df.columns)
    return c, sorted(repr([norm(r[x]) for x in c]) for r in df.collect())


def sql_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    c = sorted(rel.columns)
    at = [rel.columns.index(x) for x in c]
    return c, sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())
