"""Small column builders shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """num / den, 0.0 where the denominator is zero or null."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def div(num, den) -> Column:
    """num / den, NULL where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def rnd(x, places: int = 9) -> Column:
    """Rounded double without negative zero, so that two engines print the same value."""
    return F.round(col(x).cast("double"), places) + F.lit(0.0)


def correlation(x, y) -> Column:
    """Aggregate: Pearson correlation, NaN where a side does not vary (``corr`` fails there under ANSI)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return F.when(F.count_if(both) > 0, F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(float("nan"))))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def counted(cond: Column, rows: str | None = None) -> Column:
    """Aggregate: rows that meet ``cond``; ``rows`` names the number of rows that a row stands for."""
    return F.count_if(cond) if rows is None else F.sum(F.when(cond, F.col(rows)).otherwise(0))


def mean(x, rows: str) -> Column:
    """Aggregate: mean of ``x`` where a row stands for ``rows`` rows; nulls do not count."""
    return div(F.sum(col(x) * F.col(rows)), F.sum(F.when(col(x).isNotNull(), F.col(rows))))


def sha256(x) -> Column:
    return F.sha2(col(x).cast("string").cast("binary"), 256)


def u32(text: Column) -> Column:
    """First 32 bits of sha256(text) as a long: the deterministic stand-in for a random draw."""
    return F.conv(F.substring(sha256(text), 1, 8), 16, 10).cast("long")


def unit(text: Column) -> Column:
    """Deterministic uniform draw in [0, 1)."""
    return u32(text).cast("double") / F.lit(4294967296.0)


def joined(sep: str, *parts) -> Column:
    return F.concat_ws(sep, *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])


def sorted_text(x) -> Column:
    """Aggregate: distinct values of a small domain as sorted, comma-joined text."""
    return F.array_join(F.sort_array(F.collect_set(col(x).cast("string"))), ",")


def explode_values(name: str, values) -> Column:
    """One row per parameter value; replaces a join with a small design grid."""
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def sign_int(x) -> Column:
    return F.signum(col(x)).cast("int")
