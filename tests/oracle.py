"""Spark results against DuckDB's."""

import glob
import math
import os

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (bool, int)) else str(v)


def connect(folder):
    c = duckdb.connect(config={"threads": 2})
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*' if os.path.isdir(f) else ''}'")
    return c


def same(df, sql, folder):
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert mine == theirs
