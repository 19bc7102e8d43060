"""Runs a query and its SQL over the same tables and compares the rows."""

import datetime
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def connection(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def compare(df, sql, folder):
    found = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = connection(folder).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted(tuple(plain(dict(zip(names, x))[c]) for c in sorted(names)) for x in r.fetchall())
    assert found == wanted
