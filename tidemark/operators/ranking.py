"""Attribution, feature ranking and selection stability (K).

Attributions arrive as a long table (run keys, sample, feature, value, attribution).  After the first
aggregate every table is runs x features, where windows per run see only the feature dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, count_if, div, sha256, sign_int
from .cumulative import spearman


def linear_attribution(rows: DataFrame, train: DataFrame, background: DataFrame, coefficients: DataFrame) -> DataFrame:
    """coefficient x (z - mean background z), z standardised on the training rows (population sd).
    Statistics have one row per feature, so they are the broadcast side."""
    s = train.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    b = background.groupBy("feature").agg(F.avg("value").alias("_b"))
    side = s.join(b, "feature").join(coefficients, "feature")
    z = F.coalesce(F.try_divide(F.col("value") - F.col("_b"), F.col("_s")), F.lit(0.0))
    return rows.join(F.broadcast(side), "feature").withColumn("attribution", F.col("coefficient") * z).drop("_m", "_s", "_b", "coefficient")


def global_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per run and feature: mean |a|, mean a, rank correlation of value and a (0 for constants), sign, rank."""
    m = df.groupBy(*keys, "feature").agg(
        F.round(F.avg(F.abs("attribution")), 12).alias("mean_abs"), F.round(F.avg("attribution"), 12).alias("mean_attribution"))
    rho = spearman(df, [*keys, "feature"], "value", "attribution", constant=0.0)
    out = m.join(rho.select(*keys, "feature", F.round("rho", 9).alias("direction_correlation")), [*keys, "feature"])
    w = Window.partitionBy(*keys)
    return out.withColumns({
        "direction_sign": sign_int("direction_correlation"),
        "rank": F.rank().over(w.orderBy(F.col("mean_abs").desc())),
        "ord": F.row_number().over(w.orderBy(F.col("mean_abs").desc(), "feature")),
    })


def fold_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the run's total importance and the unique rank by (share desc, feature)."""
    w = Window.partitionBy(*keys)
    out = summary.withColumn("normalized_importance", F.round(F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(w)), 12))
    return out.withColumn("unique_rank", F.row_number().over(w.orderBy(F.col("normalized_importance").desc(), "feature")))


def top_k(scores: DataFrame, keys: list[str], score: str, k: int, name: str = "feature") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    return scores.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def compare_rankings(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs``: one row per (pair keys, feature) with ord/rank/sign of both sides."""
    l, r = F.col("left_ord"), F.col("right_ord")
    same = F.col("left_sign") == F.col("right_sign")
    jac = [F.round(div(count_if((l <= k) & (r <= k)), count_if((l <= k) | (r <= k))), 9).alias(f"top{k}_jaccard") for k in (10, 15, 20)]
    w = Window.partitionBy(*keys)
    avg = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0
    ranked = pairs.withColumns({"_rl": avg("left_rank"), "_rr": avg("right_rank")})
    top = (l <= 20) | (r <= 20)
    return ranked.groupBy(*keys).agg(
        *jac, correlation("_rl", "_rr").alias("rank_spearman"),
        F.round(F.avg(same.cast("double")), 9).alias("direction_agreement_all"),
        F.round(F.avg(F.when(top, same.cast("double"))), 9).alias("direction_agreement_top20"))


def ranking_pairs(summary: DataFrame, same: list[str], differ: str) -> DataFrame:
    """Unordered pairs of runs that agree on ``same`` and differ on ``differ``, joined on the feature."""
    side = lambda t: summary.select(*same, "feature", F.col(differ).alias(f"{t}_run"), F.col("ord").alias(f"{t}_ord"),
                                    F.col("rank").alias(f"{t}_rank"), F.col("direction_sign").alias(f"{t}_sign"))
    return side("left").join(side("right"), [*same, "feature"]).filter("left_run < right_run")


def feature_stability(summary: DataFrame, keys: list[str], k: int, n_runs: Column | None = None) -> DataFrame:
    """Top-k frequency, rank mean/sd and majority direction per feature over the runs of a key."""
    s = F.col("direction_sign")
    g = summary.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_runs"), count_if(F.col("ord") <= k).alias("top_k_count"),
        F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("rank_sd"),
        F.round(F.avg("mean_abs"), 12).alias("mean_importance"), count_if(s > 0).alias("positive"), count_if(s < 0).alias("negative"))
    eligible = F.col("positive") + F.col("negative")
    return g.withColumns({
        "top_k_frequency": F.round(F.col("top_k_count") / F.col("n_runs"), 9),
        "majority_sign": F.when(eligible == 0, 0).when(F.col("negative") >= F.col("positive"), -1).otherwise(1),
        "direction_consistency": F.round(div(F.greatest("positive", "negative"), eligible), 9),
    })


def stable_set(stability: DataFrame, frequency: float, direction: float) -> DataFrame:
    ok = (F.col("top_k_frequency") >= frequency) & F.coalesce(F.col("direction_consistency") >= direction, F.lit(False))
    return stability.withColumn("selected", ok)


def composite_scores(folds: DataFrame, keys: list[str], n_folds: int = 5, n_features: int = 35, ks=(10, 15, 20)) -> DataFrame:
    """importance x top-k frequency x direction consistency x (1 - MAD(rank) / (n_features - 1))."""
    med = folds.groupBy(*keys, "feature").agg(F.percentile("unique_rank", F.lit(0.5)).alias("median_rank"))
    j = folds.join(med, [*keys, "feature"])
    s = F.col("direction_sign")
    g = j.groupBy(*keys, "feature").agg(
        F.avg("normalized_importance").alias("importance"), F.avg("unique_rank").alias("mean_rank"), F.first("median_rank").alias("median_rank"),
        (F.percentile(F.abs(F.col("unique_rank") - F.col("median_rank")), F.lit(0.5)) / (n_features - 1)).alias("dispersion"),
        (F.greatest(count_if(s == 1), count_if(s == -1)) / float(n_folds)).alias("consistency"),
        *[(count_if(F.col("unique_rank") <= k) / float(n_folds)).alias(f"top{k}_frequency") for k in ks])
    out = g.withColumns({f"score_{k}": F.round(F.col("importance") * F.col(f"top{k}_frequency") * F.col("consistency") * (1 - F.col("dispersion")), 12)
                         for k in ks} | {"importance": F.round("importance", 12)})
    for k in ks:
        w = Window.partitionBy(*keys).orderBy(F.col(f"score_{k}").desc(), F.col("importance").desc(), "mean_rank", "feature")
        out = out.withColumn(f"rank_{k}", F.row_number().over(w))
    return out


def ablated_scores(scores: DataFrame) -> DataFrame:
    """The composite with one factor dropped at a time."""
    i, f, c, d = F.col("importance"), F.col("top15_frequency"), F.col("consistency"), 1 - F.col("dispersion")
    return scores.withColumns({
        "no_direction": F.round(i * f * d, 12), "no_dispersion": F.round(i * f * c, 12), "no_frequency": F.round(i * c * d, 12)})


def random_subsets(features: DataFrame, seeds: int, k: int) -> DataFrame:
    """Per seed the k features with the smallest sha256(seed:feature), in dictionary order, with a list hash."""
    s = features.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    s = s.withColumn("_h", sha256(F.concat_ws(":", F.col("seed").cast("string"), F.col("feature").cast("string"))))
    return s.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy("_h"))).filter(F.col("_r") <= k).drop("_h", "_r")


def list_hash(sets: DataFrame, keys: list[str]) -> DataFrame:
    g = sets.groupBy(*keys).agg(F.array_sort(F.collect_set("feature")).alias("features"))
    return g.withColumn("list_sha256", sha256(F.concat(F.lit("["), F.array_join(F.col("features").cast("array<string>"), ","), F.lit("]"))))


def binned_information(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information of label and decile-binned feature, in nats.  Bins replace the neighbour-based
    estimator: counts per (feature, bin, label) are all that is shuffled."""
    from .cumulative import quantiles

    edges = quantiles(df, ["feature"], "value", {f"e{i}": i / bins for i in range(1, bins)})
    names = [f"e{i}" for i in range(1, bins)]
    # one row per feature
    j = df.join(F.broadcast(edges), "feature")
    b = sum([(F.col("value") > F.round(F.col(n), 12)).cast("int") for n in names], F.lit(0))
    c = j.groupBy("feature", b.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature")
    c = c.withColumns({"t": F.sum("n").over(w), "nb": F.sum("n").over(Window.partitionBy("feature", "bin")),
                       "ny": F.sum("n").over(Window.partitionBy("feature", "label"))})
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))
    return c.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def direction_conflicts(pairs: DataFrame, k: int = 15) -> DataFrame:
    """Features in either top-k whose two signs are non-zero and opposite."""
    top = (F.col("left_ord") <= k) | (F.col("right_ord") <= k)
    return pairs.filter(top & (F.col("left_sign") * F.col("right_sign") < 0))
