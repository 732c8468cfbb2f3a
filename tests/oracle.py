"""Both sides of a query, compared as the driver does: columns by name, rows as a bag."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def norm(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def compare(spark, con, d, query, sql):
    df = query(spark, d)
    cols = sorted(df.columns)
    mine = Counter(tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in found.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
