"""Comparison of a query with its SQL twin in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, sql, con):
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in got.fetchall()), key=str)
    assert len(ours) == len(theirs)
    assert ours == theirs
