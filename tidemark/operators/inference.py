"""Resampling and inference (L).  Run-level groups hold one value per repetition of the design (ten);
row-level work (influence values, cluster sums, entity bootstrap) stays in aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, div, joined, sha256, u32
from .cumulative import cumulative_by_key
from .skew import skew_join

T975_DF9 = 2.2621571627409915  # fixed value: Student t quantile 0.975, 9 degrees of freedom


def stable_seed(*parts) -> Column:
    """Integer of the first 16 hex digits of sha256(parts joined by |), modulo 2^32."""
    return F.conv(F.substring(sha256(joined("|", *parts)), 9, 8), 16, 10).cast("long")


def bootstrap_means(df: DataFrame, keys: list[str], value: str, order: str, draws: int) -> DataFrame:
    """(keys, draw, mean): means of resamples; the index of item i in draw b is u32(keys|b|i) mod n."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))).alias("a"))
    g = g.select(*keys, F.transform("a", lambda s: s["v"]).alias("v"), joined("|", *keys).alias("_k"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    b = g.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition(cores, "draw")
    n = F.size("v")
    pick = lambda i: F.element_at(F.col("v"), (u32(F.concat_ws("|", "_k", F.col("draw").cast("string"), i.cast("string"))) % n + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + pick(i))
    return b.select(*keys, "draw", (total / n).alias("mean"))


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: str, draws: int) -> DataFrame:
    """Percentile interval of the mean.  ``draws`` values per key: a bounded group."""
    m = bootstrap_means(df, keys, value, order, draws)
    return m.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))


def wilcoxon(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """W+, number of non-zero pairs and the tie term (sum of t^3 - t) per key."""
    d = df.filter(F.col(value) != 0).withColumn("_a", F.round(F.abs(value), 12))
    w = Window.partitionBy(*keys).orderBy("_a")
    same = Window.partitionBy(*keys, "_a")
    t = F.count(F.lit(1)).over(same)
    r = d.withColumns({"_r": F.rank().over(w) + (t - 1) / 2.0, "_t": t})
    nz = r.groupBy(*keys).agg(F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
                              F.count(F.lit(1)).alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("tie_term"))
    return df.select(*keys).distinct().join(nz, keys, "left").na.fill(0, ["w_plus", "n", "tie_term"])


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, name: str) -> DataFrame:
    """p * m / rank with the running minimum from the largest, capped at 1; ties by p share the minimum.
    One row per test, so a family is as long as the list of hypotheses."""
    w = Window.partitionBy(*family).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    out = df.withColumn("_r", F.row_number().over(w)).withColumn("_m", m)
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return out.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back))).drop("_r", "_m")


def one_sample(df: DataFrame, keys: list[str], value: str, margin: float, critical: float = T975_DF9) -> DataFrame:
    """Mean, sd, t statistic against a margin, t interval and standardised effect."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return g.withColumns({"t_statistic": F.try_divide(F.col("mean") - margin, se), "ci_low": F.col("mean") - critical * se,
                          "ci_high": F.col("mean") + critical * se, "effect": F.try_divide(F.col("mean") - margin, F.col("sd"))})


def dependence_grid(summary: DataFrame, rhos: list[float], margin: float, critical: float = T975_DF9) -> DataFrame:
    """Effective sample size n / (1 + (n-1) rho) and the correlated standard error along a rho grid."""
    g = summary.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos])))
    eff = F.col("n") / (1.0 + (F.col("n") - 1) * F.col("rho"))
    se = F.col("sd") / F.sqrt(eff)
    return g.withColumns({"effective_n": eff, "adjusted_se": se, "ci_low": F.col("mean") - critical * se, "ci_high": F.col("mean") + critical * se,
                          "above_margin": F.round(F.col("mean") - critical * se, 9) > margin})


def auc_influence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows plus ``influence``: centred placement value over the class size; sums to 0 per key.

    Placement values are a function of (keys, score), so they are computed once per distinct score and
    looked up by the rows through the hot-key-safe join.
    """
    s = cumulative_by_key(df, keys, "p", {"pos": F.count_if(F.col("label") == 1), "neg": F.count_if(F.col("label") == 0)})
    v10 = div(F.col("cum_neg") - F.col("neg") / 2.0, "tot_neg")
    v01 = div(F.col("tot_pos") - F.col("cum_pos") + F.col("pos") / 2.0, "tot_pos")
    auc = s.groupBy(*keys).agg(F.sum(F.col("pos") * v10 / F.col("tot_pos")).alias("auc"))
    # one row per run
    side = s.join(F.broadcast(auc), keys).select(
        *keys, "p", (F.col("pos") + F.col("neg")).alias("_w"), "auc",
        ((v10 - F.col("auc")) / F.col("tot_pos")).alias("_i1"), ((v01 - F.col("auc")) / F.col("tot_neg")).alias("_i0"))
    out = skew_join(df, side, [*keys, "p"], "_w")
    return out.withColumn("influence", F.when(F.col("label") == 1, F.col("_i1")).otherwise(F.col("_i0"))).drop("_i1", "_i0", "_w")


def entity_influence(df: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Sum of influence values per (keys, entity) without touching the rows: influence depends only on
    (score, class), so rows first reduce to counts per (keys, entity, score)."""
    cells = df.groupBy(*keys, entity, "p").agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg"))
    s = cells.groupBy(*keys, "p").agg(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"), F.count(F.lit(1)).alias("_w"))
    from .cumulative import running_sums

    s = running_sums(s, keys, "p", ["pos", "neg"])
    v10 = div(F.col("cum_neg") - F.col("neg") / 2.0, "tot_neg")
    v01 = div(F.col("tot_pos") - F.col("cum_pos") + F.col("pos") / 2.0, "tot_pos")
    auc = s.groupBy(*keys).agg(F.sum(F.col("pos") * v10 / F.col("tot_pos")).alias("auc"))
    side = s.join(F.broadcast(auc), keys).select(
        *keys, "p", "_w", ((v10 - F.col("auc")) / F.col("tot_pos")).alias("_i1"), ((v01 - F.col("auc")) / F.col("tot_neg")).alias("_i0"))
    j = skew_join(cells, side, [*keys, "p"], "_w")
    return j.groupBy(*keys, entity).agg(F.sum(F.col("_pos") * F.col("_i1") + F.col("_neg") * F.col("_i0")).alias("contribution"))


def covariance_pairs(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, left, right, covariance): upper triangle of sum(a*b) in one aggregate, no self-join."""
    sums = wide.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(columns)
                                     for j, b in enumerate(columns) if j >= i])
    rows = F.array(*[F.struct(F.lit(i).alias("left_run"), F.lit(j).alias("right_run"), F.col(f"s{i}_{j}").alias("covariance"))
                     for i in range(len(columns)) for j in range(i, len(columns))])
    return sums.select(*keys, F.inline(rows))


def cluster_interval(cov: DataFrame, observed: DataFrame, keys: list[str], draws: int = 20000, seed: int = 20261701) -> DataFrame:
    """Gaussian multiplier plus outer bootstrap over repetitions from the clipped covariance.
    One small matrix (repetitions x repetitions) per key, by design."""
    both = cov.select(*keys, "left_run", "right_run", F.col("covariance").alias("v")).unionByName(
        observed.select(*keys, F.col("run").alias("left_run"), F.lit(-1).alias("right_run"), F.col("delta").alias("v")))
    types = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", observed_mean double, ci_low double, ci_high double, tail_p double, min_eigenvalue double"

    def run(pdf):
        obs = pdf[pdf.right_run < 0].sort_values("left_run")["v"].to_numpy(float)
        n = len(obs)
        c = np.zeros((n, n))
        for i, j, v in pdf[pdf.right_run >= 0][["left_run", "right_run", "v"]].itertuples(index=False):
            c[int(i), int(j)] = c[int(j), int(i)] = v
        values, vectors = np.linalg.eigh(c)
        root = vectors * np.sqrt(np.clip(values, 0, None))
        rng = np.random.default_rng(seed)
        noise = rng.standard_normal((draws, n)) @ root.T
        idx = rng.integers(0, n, (draws, n))
        m = np.take_along_axis(obs[None, :] + noise, idx, axis=1).mean(axis=1)
        tail = max(1 / (draws + 1), 2 * min((m <= 0).mean(), (m >= 0).mean()))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "observed_mean": obs.mean(), "ci_low": np.quantile(m, 0.025),
                              "ci_high": np.quantile(m, 0.975), "tail_p": min(1.0, tail), "min_eigenvalue": values.min()}])

    return both.groupBy(*keys).applyInPandas(run, schema)


def entity_bootstrap(df: DataFrame, keys: list[str], entity: str, threshold: Column, draws: int = 2000) -> DataFrame:
    """Domain-equal Macro-F1 interval: Poisson(1) weights per (entity, draw) from a hash, summed by draw.
    The exploded rows are combined on the map side to ``draws`` rows per key and task."""
    from .metrics import confusion, f1_macro

    per = confusion(df, [*keys, entity], threshold)
    size = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    per = per.select(*keys, entity, *[div(c, size).alias(c) for c in ("tp", "fp", "fn", "tn")])
    b = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    u = (F.pmod(F.xxhash64(*keys, entity, "draw"), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    # inverse of the Poisson(1) distribution function; draw 0 is the point estimate
    cuts, acc, term = [], 0.0, float(np.exp(-1.0))
    for k in range(1, 12):
        acc += term
        cuts.append(acc)
        term /= k
    weight = F.when(F.col("draw") == 0, 1.0).otherwise(sum([(u > c).cast("double") for c in cuts], F.lit(0.0)))
    s = b.groupBy(*keys, "draw").agg(*[F.sum(weight * F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    m = s.select(*keys, "draw", f1_macro(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("f1"))
    boot = F.when(F.col("draw") > 0, F.col("f1"))
    return m.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col("f1"))).alias("macro_f1"), F.count(boot).alias("draws"),
                                F.percentile(boot, F.lit(0.025)).alias("ci_low"), F.percentile(boot, F.lit(0.975)).alias("ci_high"))


def sign_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_delta"), F.percentile(value, F.lit(0.5)).alias("median_delta"),
        count_if(v > 0).alias("positive"), count_if(v < 0).alias("negative"), count_if(v == 0).alias("zero"))
