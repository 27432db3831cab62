"""Runs a query on Spark and its counterpart on DuckDB, as sorted rows of rounded values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def both(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df, r = query(spark, folder), con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    return rows(df.columns, df.collect()), rows(r.columns, r.fetchall())
