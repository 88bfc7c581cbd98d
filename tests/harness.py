"""Runs registered queries in Spark and DuckDB and compares them, columns sorted by name, rows as a multiset."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import time

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_canon(r[i]) for i in order) for r in rows)


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    cols, rows = spark_rows(fn(spark, sf))
    seconds = time.time() - t
    out = {"name": name, "rows": len(rows), "seconds": seconds, "ok": True, "why": ""}
    if sql is None:
        return out
    t = time.time()
    dcols, drows = duck_rows(con, sql)
    out["duck"] = time.time() - t
    if sorted(cols) != sorted(dcols):
        return {**out, "ok": False, "why": f"columns {sorted(set(cols) ^ set(dcols))}"}
    a, b = canonical(cols, rows), canonical(dcols, drows)
    if a != b:
        sa, sb = set(a), set(b)
        diff_a, diff_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        return {**out, "ok": False, "why": f"{len(a)} vs {len(b)}\n   spark {diff_a}\n   duck  {diff_b}\n   {sorted(cols)}"}
    return out
