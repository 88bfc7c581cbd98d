"""Ordered cumulative sums per key: the core under AUC, thresholds, KS, Wasserstein, ranks and quantiles.

Rows are first reduced to one per (keys, order value).  Over large inputs the order axis is then cut into blocks by the
leading bits of each value's floating-point form, and a block with more than ``BLOCK_ROWS`` values is cut again by
further bits: block totals give each block its offset and the running sum is taken inside (keys, block), so no task ever
sorts a whole key.  Cuts depend on the values alone: no job runs while a query is planned, and a retried task sees the
same blocks.  Where the tables read are below ``WINDOW_BYTES`` together a plain window serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4_000_000
WINDOW_BYTES = 1 << 27
COARSE, FINE = 8, 24  # mantissa bits of a block, and of a block that was too full


def is_large(df: DataFrame) -> bool:
    """Whether the tables below ``df`` hold more than ``WINDOW_BYTES``, by the optimizer's figures; nothing runs."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return True
    leaves = plan.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) > WINDOW_BYTES


def radix(order: str, bits: int) -> Column:
    """A whole number that grows with the value: sign, exponent and ``bits`` leading bits of the mantissa.
    Nulls come first and NaN last, as in Spark's order; the block of fewer bits is this number without its last bits."""
    x = F.col(order).cast("double")
    size = F.abs(x)
    exponent = F.greatest(F.lit(-1074), F.least(F.lit(1023), F.floor(F.log2(size)).cast("int")))
    part = F.floor((size / F.pow(F.lit(2.0), exponent.cast("double")) - 1.0) * float(1 << bits))
    code = (exponent.cast("long") + 1075) * (1 << bits) + F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), part)).cast("long")
    end = F.lit(3000 << bits).cast("long")
    return F.when(x.isNull(), -end - 1).when(F.isnan(x), end + 1).when(size == float("inf"), F.signum(x).cast("long") * end).when(
        x == 0, F.lit(0).cast("long")).otherwise(F.signum(x).cast("long") * code)


def _with_block(counts: DataFrame, keys: list[str], order: str, block_rows: int) -> DataFrame:
    shift = FINE - COARSE
    tagged = counts.withColumn("_coarse", radix(order, COARSE))
    full = tagged.groupBy(*keys, "_coarse").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
    full = full.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col("_coarse").alias("_full"))
    cond = F.col("_coarse") == F.col("_full")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    fine = F.when(F.col("_full").isNull(), F.col("_coarse") * (1 << shift)).otherwise(radix(order, FINE))
    return tagged.join(full, cond, "left").withColumn("_block", fine).drop("_coarse", "_full", *[f"_f_{k}" for k in keys])


def running_sums(counts: DataFrame, keys: list[str], order: str, sums: list[str], block_rows: int | None = None,
                 following: str | None = None) -> DataFrame:
    """``counts`` has one row per (keys, order).  Adds ``cum_x`` (inclusive, ascending) and ``tot_x`` per
    key for every x in ``sums``; with ``following`` also that column: the next order value of the key.
    ``block_rows``: cut blocks in any case, of about that many values."""
    whole = Window.partitionBy(*keys)
    if block_rows is None and not is_large(counts):
        w = whole.orderBy(order)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols = {f"cum_{s}": F.sum(s).over(run) for s in sums} | {f"tot_{s}": F.sum(s).over(full) for s in sums}
        if following:
            cols[following] = F.lead(order).over(w)
        return counts.withColumns(cols)
    tagged = _with_block(counts, keys, order, block_rows or BLOCK_ROWS)
    blocks = tagged.groupBy(*keys, "_block").agg(*[F.sum(s).alias(f"_b_{s}") for s in sums], F.min(order).alias("_lo"))
    wb = whole.orderBy("_block")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    full = wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = blocks.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_kb"), F.lead("_lo").over(wb).alias("_next"),
        *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(full).alias(f"tot_{s}") for s in sums])
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tagged.withColumns({f"_cum_{s}": F.sum(s).over(run) for s in sums})
    if following:
        out = out.withColumn("_lead", F.lead(order).over(local))
    cond = F.col("_block") == F.col("_kb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(offsets, cond)
    extra = [F.coalesce("_lead", "_next").alias(following)] if following else []
    return out.select(*counts.columns, *[(F.col(f"_cum_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
                      *[F.col(f"tot_{s}") for s in sums], *extra)


def cumulative_by_key(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column],
                      block_rows: int | None = None, following: str | None = None) -> DataFrame:
    """Reduce rows to one per (keys, order) with the given sums, then running_sums."""
    counts = df.groupBy(*keys, order).agg(*[c.alias(n) for n, c in sums.items()])
    return running_sums(counts, keys, order, list(sums), block_rows, following)


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None,
                block_rows: int | None = None) -> DataFrame:
    """(keys, value, n, tot_n, avg_rank): the average rank of each distinct value, ties shared."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    out = cumulative_by_key(df.filter(F.col(value).isNotNull()), keys, value, {"n": n}, block_rows)
    return out.select(*keys, value, "n", "tot_n",
                      (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], block_rows: int | None = None,
              rows: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, read off the running counts."""
    n = F.sum(rows) if rows else F.count(F.lit(1))
    cum = cumulative_by_key(df.filter(F.col(value).isNotNull()), keys, value, {"n": n}, block_rows)
    lo_n, hi_n = F.col("cum_n") - F.col("n"), F.col("cum_n")
    aggs = []
    for name, q in qs.items():
        h = (F.col("tot_n") - 1) * F.lit(float(q))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when((lo_n <= pos) & (pos < hi_n), F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_f_{name}"))
    out = cum.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in qs])


def hash_rank(df: DataFrame, keys: list[str], hash_col: str, ties: list[str]) -> DataFrame:
    """Adds ``_rank`` (1-based, by hash then ties) and ``_total`` per key.  The first three hex digits
    of a sha256 cut the rows into 4096 even blocks, so a key of any size is ranked in parallel."""
    tagged = df.withColumn("_block", F.substring(hash_col, 1, 3))
    blocks = tagged.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_block")
    offsets = blocks.withColumns({
        "_off": F.coalesce(F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).drop("_n")
    local = Window.partitionBy(*keys, "_block").orderBy(hash_col, *ties)
    out = tagged.withColumn("_local", F.row_number().over(local)).join(offsets, [*keys, "_block"])
    return out.select(*df.columns, (F.col("_off") + F.col("_local")).alias("_rank"), "_total")


def _small_spearman(df, keys, x, y, constant):
    """Centred average ranks by window: rows up to and including the peers, less half the peers."""
    whole = Window.partitionBy(*keys)
    one = F.count(F.lit(1))

    def centred(c):
        w = whole.orderBy(c)
        upto = one.over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        peers = one.over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return upto - peers / 2.0 - one.over(w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 2.0

    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, centred(x).alias("_rx"), centred(y).alias("_ry"))
    agg = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(F.col("_ry") * F.col("_ry")).alias("_yy"))
    rho = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return agg.select(*keys, "n", F.coalesce(rho, F.lit(constant).cast("double")).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, constant: float | None = None,
             block_rows: int | None = None) -> DataFrame:
    """(keys, n, rho): rank correlation with shared ties; ``constant`` where a side does not vary.

    Where the input is expected to be small, both ranks are windows over the keys: one shuffle.  Beyond that the ranks
    come from the counts per (keys, x) and (keys, y), taken in blocks.
    """
    from .skew import skew_join

    if block_rows is None and not is_large(df):
        return _small_spearman(df, keys, x, y, constant)
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))

    def marginal(v, out):
        per = cells.groupBy(*keys, v).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_cells"))
        cum = running_sums(per, keys, v, ["n"], block_rows)
        return cum.select(*keys, v, "_cells", (F.col("cum_n") - F.col("n") / 2.0 - F.col("tot_n") / 2.0).alias(out))

    j = skew_join(cells, marginal("_x", "_rx"), [*keys, "_x"], "_cells").drop("_cells")
    j = skew_join(j, marginal("_y", "_ry"), [*keys, "_y"], "_cells").drop("_cells")
    n = F.col("_n")
    agg = j.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(n * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(n * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(n * F.col("_ry") * F.col("_ry")).alias("_yy"))
    rho = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return agg.select(*keys, "n", F.coalesce(rho, F.lit(constant).cast("double")).alias("rho"))
