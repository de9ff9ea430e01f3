"""Runs registered queries and their SQL side by side and compares whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(cell(x)) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}={cell(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when both give the same columns and rows."""
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in found.description}
    ours = {c: t for c, t in df.dtypes}
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}: {ours[c]}/{kinds[c]}" for c in names if ours[c] in loose and loose[ours[c]] != kinds[c]]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
    if a != b:
        only = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; {str(only)[:700]} {odd}"
    return f"types {odd}" if odd else ""
