"""Runs a query and its SQL and compares them as the driver does: columns by name, rows in any order."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd


def connection(d):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    return con


def _cell(x):
    if x is None or x is pd.NA or isinstance(x, (float, np.floating)) and np.isnan(x):
        return None
    if isinstance(x, (np.floating, float, decimal.Decimal)):
        return float(x)
    return int(x) if isinstance(x, (np.integer, int)) and not isinstance(x, (bool, np.bool_)) else str(x)


def rows(df):
    out = [tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


def assert_same(spark, con, d, query, text):
    a, b = query(spark, d).toPandas(), con.execute(text).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert [p for p in zip(x, y, strict=True) if p[0] != p[1]][:3] == []
