"""Distribution shift and association (I)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import counted, div
from .cumulative import cumulative_by_key, quantiles


def two_sample(df: DataFrame, keys: list[str], value: str, is_left: Column, rows: str | None = None) -> DataFrame:
    """KS statistic and Wasserstein distance between two sides per key, from one running count."""
    c = cumulative_by_key(df.withColumn("_left", is_left), keys, value, {
        "nl": counted(F.col("_left"), rows), "nr": counted(~F.col("_left"), rows)}, following="_next")
    gap = F.abs(div("cum_nl", "tot_nl") - div("cum_nr", "tot_nr"))
    return c.groupBy(*keys).agg(
        F.max("tot_nl").alias("n_left"), F.max("tot_nr").alias("n_right"), F.max(gap).alias("ks_statistic"),
        F.coalesce(F.sum(gap * (F.col("_next") - F.col(value))), F.lit(0.0)).alias("wasserstein_distance"))


def smd(df: DataFrame, keys: list[str], value: str, is_left: Column) -> DataFrame:
    """Standardised mean difference; pooled sd 0 gives 0 for equal means, else NULL."""
    l, r = F.when(is_left, F.col(value)), F.when(~is_left, F.col(value))
    m = df.groupBy(*keys).agg(F.avg(l).alias("mean_left"), F.avg(r).alias("mean_right"),
                              F.var_samp(l).alias("_vl"), F.var_samp(r).alias("_vr"))
    d, pooled = F.col("mean_left") - F.col("mean_right"), F.sqrt((F.col("_vl") + F.col("_vr")) / 2)
    return m.select(*keys, "mean_left", "mean_right", F.when(pooled == 0, F.when(d == 0, F.lit(0.0))).otherwise(
        F.try_divide(d, pooled)).alias("smd"))


def median_gap(df: DataFrame, keys: list[str], value: str, side: str, left: str, right: str) -> DataFrame:
    """(median_right - median_left) / pooled IQR; NULL when the IQR is 0."""
    per = quantiles(df, [*keys, side], value, {"m": 0.5})
    w = per.groupBy(*keys).agg(F.max(F.when(F.col(side) == left, F.col("m"))).alias("median_left"),
                               F.max(F.when(F.col(side) == right, F.col("m"))).alias("median_right"))
    q = quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75}).select(*keys, (F.col("q75") - F.col("q25")).alias("pooled_iqr"))
    gap = F.col("median_right") - F.col("median_left")
    return w.join(q, keys).withColumn("robust_gap", F.when(F.col("pooled_iqr") > 0, gap / F.col("pooled_iqr")))


def side_auc(df: DataFrame, keys: list[str], value: str, is_positive: Column) -> DataFrame:
    """AUC of a single value as the discriminator of a side, made symmetric: max(a, 1 - a)."""
    from .metrics import roc_auc, score_table

    s = score_table(df.withColumn("_y", is_positive.cast("int")), keys, score=value, label="_y")
    a = s.groupBy(*keys).agg(roc_auc().alias("a"))
    return a.select(*keys, F.greatest(F.col("a"), 1 - F.col("a")).alias("source_auc_symmetric"))


def js_divergence(df: DataFrame, keys: list[str], p: str, is_left: Column, bins: int = 20, rows: str | None = None) -> DataFrame:
    """Jensen-Shannon divergence of equal-width histograms on [0, 1], base 2, 1e-12 added to every bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    h = df.groupBy(*keys, b.alias("_b")).agg(counted(is_left, rows).alias("l"), counted(~is_left, rows).alias("r"))
    tot = h.groupBy(*keys).agg(F.sum("l").alias("tl"), F.sum("r").alias("tr"), F.count(F.lit(1)).alias("used"))
    eps = 1e-12
    j = h.join(tot, keys)
    pl = (F.col("l") + eps) / (F.col("tl") + eps * bins)
    pr = (F.col("r") + eps) / (F.col("tr") + eps * bins)
    mid = (pl + pr) / 2

    def part(x, m):
        return 0.5 * x * F.log2(x / m)

    # bins empty on both sides still carry the smoothing mass
    el, er = eps / (F.col("tl") + eps * bins), eps / (F.col("tr") + eps * bins)
    empty = (bins - F.col("used")) * (part(el, (el + er) / 2) + part(er, (el + er) / 2))
    return j.groupBy(*keys).agg((F.sum(part(pl, mid) + part(pr, mid)) + F.max(empty)).alias("js_divergence"))


def spearman_matrix(wide: DataFrame, keys: list[str], row: str, names: list[str]) -> DataFrame:
    """(keys, left_feature, right_feature, rho): rank correlation of every pair of ``names``, NULL where one is constant.

    One rank table serves all features.  A row's centred ranks meet in one vector, tasks add up the outer products of
    their vectors as matrices, and Spark sums the upper triangles (names x (names + 1) / 2 numbers per task and key).
    A null counts in no product.
    """
    from .cumulative import value_ranks
    from .skew import skew_join

    k = len(names)
    long = wide.select(*keys, row, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])))
    ranks = value_ranks(long, [*keys, "feature"], "value").select(*keys, "feature", "value", "n", (F.col("avg_rank") - (F.col("tot_n") + 1) / 2.0).alias("_rank"))
    ranked = skew_join(long, ranks, [*keys, "feature", "value"], "n")
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature"))
    vectors = ranked.groupBy(*keys, row).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), "_rank"))), lambda x: x["_rank"]).alias("_v"))
    upper = np.triu_indices(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            v = np.nan_to_num(np.asarray(batch.column("_v").flatten().to_numpy(zero_copy_only=False), float)).reshape(batch.num_rows, k)
            at: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
                at.setdefault(key, []).append(i)
            for key, rows in at.items():
                total[key] = total.get(key, 0.0) + (v[rows].T @ v[rows])[upper]
        for key, sums in total.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in key), pa.array([sums.tolist()])], [*keys, "_cells"])

    schema = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in keys) + ", _cells array<double>"
    cells = vectors.select(*keys, "_v").mapInArrow(products, schema).select(*keys, F.posexplode("_cells").alias("_at", "_sum"))
    summed = cells.groupBy(*keys, "_at").agg(F.sum("_sum").alias("_sum"))
    # one row per key with the numbers of its triangle
    whole = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_sum"))).alias("_m"))
    place = {(int(i), int(j)): n for n, (i, j) in enumerate(zip(*upper))}
    pairs = ", ".join(f"named_struct('left_feature', '{names[i]}', 'right_feature', '{names[j]}', '_xy', {place[i, j]}, '_xx', {place[i, i]}, '_yy', {place[j, j]})"
                      for i in range(k) for j in range(i + 1, k))
    rho = F.try_divide(F.element_at("_m", F.col("_xy")), F.sqrt(F.element_at("_m", F.col("_xx"))) * F.sqrt(F.element_at("_m", F.col("_yy"))))
    return whole.select(*keys, "_m", F.expr(f"inline(array({pairs}))")).select(*keys, "left_feature", "right_feature", rho.alias("rho"))


def dead_zone_sign(c: Column, zone: float) -> Column:
    return F.when(F.abs(c) <= zone, 0).otherwise(F.signum(c).cast("int"))


def run_association(long: DataFrame, scopes: list[list[str]], all_keys: list[str], minimum: int = 3) -> DataFrame:
    """Spearman between predictors and outcomes of run-level rows, per scope and over all rows.

    ``long`` holds (scope columns, predictor, x, outcome, y) per run.  Run tables have one row per cell
    of the design grid, so the ranks are taken with a window over a group of that size.
    """
    from .cumulative import spearman

    out = None
    for keys in scopes:
        names = {c: F.coalesce(F.col(c).cast("string"), F.lit("all")) if c in keys else F.lit("all") for c in all_keys}
        part = long.withColumns(names)
        r = spearman(part, [*all_keys, "predictor", "outcome"], "x", "y")
        out = r if out is None else out.unionByName(r)
    return out.withColumn("rho", F.when(F.col("n") >= minimum, F.col("rho")))
