"""Compare a registered query with its SQL in DuckDB, as a multiset of rows with columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def assert_same(df, con, sql):
    (a, x), (b, y) = rows_of_spark(df), rows_of_duck(con, sql)
    assert a == b, (a, b)
    if x != y:
        raise AssertionError(f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list((x - y).items())[:4]}; only SQL {list((y - x).items())[:4]}")
