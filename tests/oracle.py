"""Holds a query's rows against those of its SQL in DuckDB, on the same Parquet tables."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def _order(row):
    return tuple((x is not None, str(type(x).__name__ if not isinstance(x, (int, float)) else ""), x if isinstance(x, (int, float)) else str(x)) for x in row)


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=_order)


def compare(df, con, sql):
    """None, or what differs first."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} against {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{sorted(got_names)}: {str(x)[:400]} against {str(y)[:400]}"
    return None
