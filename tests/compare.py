"""Runs queries in both engines, as the driver does: rows as sorted lists of their values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in values), key=lambda r: [(x is None, str(x)) for x in r])


def same(df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, cur.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if [str(v) for v in x] != [str(v) for v in y]]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
