"""Rows of a Spark query against DuckDB SQL over the same tables."""

import datetime
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    return names, sorted((tuple(norm(dict(zip(rel.columns, r))[c]) for c in names) for r in rel.fetchall()), key=str)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
