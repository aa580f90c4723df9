"""Runs a query and its SQL over the same tables."""

import glob
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.12g}") if math.isfinite(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(map(norm, v.values()))
    return v


def from_sql(folder, sql):
    """(sorted column names, multiset of rows) of a statement over a folder's tables."""
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def from_spark(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
