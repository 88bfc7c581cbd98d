"""Attaching per-group values to rows when one group may hold a large share of all rows.

A plain shuffle join on the group key, or a window over it, sends the whole group to one task.
Here the largest groups (at most ``HOT_GROUPS``, so the broadcast is bounded by construction)
are served by a broadcast hash join and their rows are spread over salted partitions; every
other group holds fewer than 1/HOT_GROUPS of the rows and goes through the shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_GROUPS = 1000
SALTS = 256


def skew_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "left",
              salt_by: list[str] | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which is unique on ``on`` and carries in ``weight`` the number of
    left rows per key.  Keeps ``left``'s columns and adds ``right``'s (weight included).
    ``salt_by`` names columns that tell the rows of a group apart (default: all of them)."""
    extra = [c for c in right.columns if c not in on]
    top = right.orderBy(F.col(weight).desc(), *[F.col(k).asc() for k in on]).limit(HOT_GROUPS)
    hot = top.select(*[F.col(k).alias(f"_h_{k}") for k in on], F.struct(*extra).alias("_hot"))
    cond = None
    for k in on:
        c = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(F.broadcast(hot), cond, "left").drop(*[f"_h_{k}" for k in on])
    is_hot = F.col("_hot").isNotNull()
    out = out.withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(*(salt_by or left.columns)), F.lit(SALTS)) + 1).otherwise(F.lit(0)))
    cold = right.select(*[F.col(k).alias(f"_c_{k}") for k in on], F.struct(*extra).alias("_cold"),
                        F.lit(0).cast("long").alias("_c_salt"))
    cond = F.col("_salt") == F.col("_c_salt")
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    out = out.join(cold, cond, "left").withColumn("_stat", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter(F.col("_stat").isNotNull())
    return out.select(*left.columns, *[F.col(f"_stat.{c}").alias(c) for c in extra])


def with_group_stats(df: DataFrame, keys: list[str], aggs: dict[str, Column],
                     salt_by: list[str] | None = None) -> DataFrame:
    """Aggregate window ``agg over (partition by keys)`` without moving a group into one task."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()], F.count(F.lit(1)).alias("_rows"))
    return skew_join(df, stats, keys, "_rows", salt_by=salt_by).drop("_rows")
