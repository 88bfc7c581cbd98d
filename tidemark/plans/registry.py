"""Registered queries: name -> (Spark plan, DuckDB text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {"urls": fx.URLS_SQL, "raw": fx.RAW_SQL, "scored": fx.SCORED_SQL, "attr": fx.ATTR_SQL}


def with_views(body: str, *views: str, ctes: str = "") -> str:
    """The query text behind the named fixture views and any further CTEs."""
    parts = [VIEWS[v].strip() for v in views]
    if ctes:
        parts.append(ctes.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def register(name: str, fn, sql: str | None = None, views: tuple = (), ctes: str = "") -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = with_views(sql, *views, ctes=ctes)


def query(name: str, sql: str | None = None, views: tuple = (), ctes: str = ""):
    def wrap(fn):
        register(name, fn, sql, views, ctes)
        return fn

    return wrap
