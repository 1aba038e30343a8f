"""Comparison of a query with its SQL on the small tables."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def same(df, sql, con):
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.select(*columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
