"""Comparing a query with its SQL on the same tables."""

import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    return con


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark, sf, query, sql):
    mine, theirs = query(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
