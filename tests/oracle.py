"""Compares a Spark result with DuckDB's over the same tables, without order."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(round(v, 9)))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    return tuple(plain(x) for x in v)


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


def same(df, connection, sql):
    rows, cols = df.collect(), sorted(df.columns)
    rel = connection.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    other = [tuple(plain(r[names.index(k)]) for k in cols) for r in rel.fetchall()]
    mine = [tuple(plain(r[k]) for k in cols) for r in rows]
    key = lambda r: repr(r)
    assert sorted(mine, key=key) == sorted(other, key=key)
