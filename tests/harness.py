"""Runs a query and its SQL side by side and compares rows as sets of rounded values."""
from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

from foliant.registry import TABLES

SF = os.environ.get("FOLIANT_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return str(v) if not isinstance(v, (int, str, bytes, bool, type(None))) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sql: str, sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def difference(spark, name, fn, sql, sf: str = SF) -> str | None:
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names, rows = oracle(sql, sf)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want = rows_of(names, rows)
    if got != want:
        return f"{sum(got.values())} / {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return None
