"""Rows of a query and of its SQL in DuckDB, in a comparable form."""
import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def assert_equal(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duck(sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want
    return got
