"""Runs a query and its SQL and compares them as bags of rows."""

import os
from decimal import Decimal

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, (float, Decimal)):
        return round(float(value), 9) + 0.0
    return value


def assert_same(df, con, sql):
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    rows = [tuple(plain(dict(zip(names, r))[n]) for n in sorted(names)) for r in want.fetchall()]
    assert sorted(df.columns) == sorted(names)
    got = [tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
