"""Compares a query with its DuckDB twin the way the driver does: columns by name, rows without order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("TALLYLOOM_TESTDATA", "/root/testdata")


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(canon(x) for x in v.values())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        name = f.removesuffix(".parquet")
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.execute(f"create view {name} as select * from read_parquet('{path}')")
    return c


def compare(spark, name, query, sql, folder):
    got = query(spark, folder)
    want = duck(folder).execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names), (name, sorted(got.columns), sorted(names))
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    assert len(a) == len(b), (name, len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, (name, len(different), different[:3])
    return len(a)
