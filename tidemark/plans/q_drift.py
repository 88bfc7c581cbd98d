"""I: distribution, drift, association."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.columns import count_if, mean, rnd, sign_int
from ..functions.special import kolmogorov_p
from ..functions.urls import FEATURE_NAMES
from ..operators import drift as D
from ..operators import metrics as M
from ..operators.cumulative import quantiles, spearman
from .metrics_sql import AUC, RUN, score_ctes
from .q_joins import FLONG, RUNS, long_features, runs
from .q_metrics import K
from .registry import query

URLS, SCORED, ATTR = ("urls",), ("scored",), ("attr",)
LEFT = F.col
SC = "fs AS (SELECT feature, value, dataset, scope FROM (SELECT feature, value, dataset, CASE label WHEN 0 THEN 'benign' ELSE 'phishing' END AS scope FROM fl UNION ALL SELECT feature, value, dataset, 'all' FROM fl))"
TWO = """cnt AS (SELECT scope, feature, value, count(*) FILTER (WHERE dataset = 'src_a') AS l, count(*) FILTER (WHERE dataset = 'src_b') AS r FROM fs GROUP BY ALL),
cdf AS (SELECT *, sum(l) OVER w / CAST(sum(l) OVER k AS DOUBLE) AS fa, sum(r) OVER w / CAST(sum(r) OVER k AS DOUBLE) AS fb, lead(value) OVER w AS nxt FROM cnt WINDOW w AS (PARTITION BY scope, feature ORDER BY value), k AS (PARTITION BY scope, feature)),
two AS (SELECT scope, feature, max(abs(fa - fb)) AS ks, coalesce(sum(abs(fa - fb) * (nxt - value)), 0) AS wd FROM cdf GROUP BY ALL)"""
FCT = ",".join([FLONG, SC, TWO])


def scoped(spark, sf):
    """Feature rows of every class plus all rows together."""
    return long_features(spark, sf).withColumn("scope", F.explode(F.array(
        F.when(F.col("label") == 0, "benign").otherwise("phishing"), F.lit("all"))))


KEYS = ["scope", "feature"]


def is_left():
    return F.col("dataset") == "src_a"


@query("i01_smd", """SELECT scope, feature, round(ma, 8) + 0.0 AS mean_left, round(mb, 8) + 0.0 AS mean_right, CASE WHEN sd = 0 THEN CASE WHEN ma = mb THEN 0.0 END ELSE round((ma - mb) / sd, 7) + 0.0 END AS smd FROM
 (SELECT scope, feature, avg(value) FILTER (WHERE dataset = 'src_a') AS ma, avg(value) FILTER (WHERE dataset = 'src_b') AS mb, sqrt((var_samp(value) FILTER (WHERE dataset = 'src_a') + var_samp(value) FILTER (WHERE dataset = 'src_b')) / 2) AS sd FROM fs GROUP BY ALL)""", URLS, FCT)
def i01(spark, sf):
    out = D.smd(scoped(spark, sf), KEYS, "value", is_left())
    return out.select(*KEYS, rnd("mean_left", 8).alias("mean_left"), rnd("mean_right", 8).alias("mean_right"), rnd("smd", 7).alias("smd"))


@query("i02_ks", "SELECT scope, feature, round(ks, 9) + 0.0 AS ks_statistic FROM two", URLS, FCT)
def i02(spark, sf):
    return D.two_sample(scoped(spark, sf), KEYS, "value", is_left()).select(*KEYS, rnd("ks_statistic").alias("ks_statistic"))


@query("i02_ks_pvalue")
def i02p(spark, sf):
    t = D.two_sample(scoped(spark, sf), KEYS, "value", is_left())
    p = kolmogorov_p(F.col("ks_statistic"), F.col("n_left").cast("double"), F.col("n_right").cast("double"))
    return t.select(*KEYS, rnd("ks_statistic").alias("ks_statistic"), rnd(p, 8).alias("p_value"))


@query("i03_wasserstein", "SELECT scope, feature, round(wd, 8) + 0.0 AS wasserstein_distance FROM two", URLS, FCT)
def i03(spark, sf):
    return D.two_sample(scoped(spark, sf), KEYS, "value", is_left()).select(*KEYS, rnd("wasserstein_distance", 8).alias("wasserstein_distance"))


_JS = """jh AS (SELECT repetition, model, label, b, coalesce(l, 0) + 1e-12 AS l, coalesce(r, 0) + 1e-12 AS r FROM (SELECT DISTINCT repetition, model, label FROM fx_scored) k CROSS JOIN range(0, 20) AS g(b)
 LEFT JOIN (SELECT repetition, model, label, CAST(least(floor(p * 20), 19) AS BIGINT) AS b, count(*) FILTER (WHERE dataset = 'F') AS l, count(*) FILTER (WHERE dataset = 'O') AS r FROM fx_scored GROUP BY ALL) h USING (repetition, model, label, b)),
jp AS (SELECT *, l / sum(l) OVER k AS pl, r / sum(r) OVER k AS pr FROM jh WINDOW k AS (PARTITION BY repetition, model, label)),
js AS (SELECT repetition, model, label, sum(0.5 * pl * log2(pl / ((pl + pr) / 2)) + 0.5 * pr * log2(pr / ((pl + pr) / 2))) AS js FROM jp GROUP BY ALL)"""


@query("i04_jensen_shannon", "SELECT repetition, model, label, round(js, 9) + 0.0 AS js_divergence FROM js", SCORED, _JS)
def i04(spark, sf):
    out = D.js_divergence(fx.scored_counts(spark, sf), ["repetition", "model", "label"], "p", F.col("dataset") == "F", rows="n")
    return out.withColumn("js_divergence", rnd("js_divergence"))


@query("i05_spearman_matrix", f"""SELECT a.dataset, a.feature AS left_feature, b.feature AS right_feature, CASE WHEN isnan(corr(a.rk, b.rk)) THEN NULL ELSE round(corr(a.rk, b.rk), 7) + 0.0 END AS rho, CASE WHEN isnan(corr(a.rk, b.rk)) THEN NULL ELSE abs(round(corr(a.rk, b.rk), 7)) >= 0.95 END AS strong
FROM rk a JOIN rk b ON a.dataset = b.dataset AND a.source_row = b.source_row JOIN ord oa ON a.feature = oa.f JOIN ord ob ON b.feature = ob.f AND oa.o < ob.o GROUP BY ALL""", URLS,
       FLONG + f", ord AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {i})' for i, n in enumerate(FEATURE_NAMES))}) AS t(f, o)), rk AS (SELECT dataset, source_row, feature, rank() OVER (PARTITION BY dataset, feature ORDER BY value) + (count(*) OVER (PARTITION BY dataset, feature, value) - 1) / 2.0E0 AS rk FROM fl WHERE feature IN (SELECT f FROM ord))")
def i05(spark, sf):
    """All 595 pairs of the 35 features, per dataset."""
    from ..functions import urls as U

    f = U.url_features(fx.urls(spark, sf), fx.rules(spark))
    wide = f.select("dataset", F.col("source_row").alias("row_id"), *[F.round(F.col(n).cast("double"), 10).alias(n) for n in FEATURE_NAMES])
    out = D.spearman_matrix(wide, ["dataset"], "row_id", FEATURE_NAMES).withColumn("rho", rnd("rho", 7))
    return out.withColumn("strong", F.abs("rho") >= 0.95)


_RHO = """fr AS (SELECT dataset, feature, rank() OVER (PARTITION BY dataset, feature ORDER BY value) + (count(*) OVER (PARTITION BY dataset, feature, value) - 1) / 2.0E0 AS rx, rank() OVER (PARTITION BY dataset, feature ORDER BY label) + (count(*) OVER (PARTITION BY dataset, feature, label) - 1) / 2.0E0 AS ry, value FROM fl),
rho AS (SELECT dataset, feature, CASE WHEN min(value) = max(value) THEN NULL ELSE round(corr(rx, ry), 8) + 0.0 END AS rho FROM fr GROUP BY ALL),
flip AS (SELECT feature, max(CASE WHEN dataset = 'src_a' THEN rho END) AS source_rho, max(CASE WHEN dataset = 'src_b' THEN rho END) AS target_rho FROM rho GROUP BY ALL)"""


def label_rho(spark, sf):
    return spearman(long_features(spark, sf), ["dataset", "feature"], "value", "label").select(
        "dataset", "feature", rnd("rho", 8).alias("rho"))


@query("i06_label_spearman", "SELECT * FROM rho", URLS, FLONG + "," + _RHO)
def i06(spark, sf):
    return label_rho(spark, sf)


def flips(rho):
    w = rho.groupBy("feature").agg(F.max(F.when(F.col("dataset") == "src_a", F.col("rho"))).alias("source_rho"),
                                   F.max(F.when(F.col("dataset") == "src_b", F.col("rho"))).alias("target_rho"))
    s, t = D.dead_zone_sign(F.col("source_rho"), 0.02), D.dead_zone_sign(F.col("target_rho"), 0.02)
    return w.withColumns({"source_sign": s, "target_sign": t, "direction_flip": s * t < 0,
                          "absolute_change": rnd(F.abs(F.col("target_rho") - F.col("source_rho")), 8)})


_SG = "CASE WHEN abs({0}) <= 0.02 THEN 0 ELSE CAST(sign({0}) AS INTEGER) END"


@query("i07_direction_flip", f"SELECT *, {_SG.format('source_rho')} AS source_sign, {_SG.format('target_rho')} AS target_sign, ({_SG.format('source_rho')}) * ({_SG.format('target_rho')}) < 0 AS direction_flip, round(abs(target_rho - source_rho), 8) + 0.0 AS absolute_change FROM flip", URLS, FLONG + "," + _RHO)
def i07(spark, sf):
    return flips(label_rho(spark, sf))


_AR = """ar AS (SELECT feature, repetition, held_fold, rank() OVER (PARTITION BY feature, repetition, held_fold ORDER BY attribution) + (count(*) OVER (PARTITION BY feature, repetition, held_fold, attribution) - 1) / 2.0E0 AS rx,
 rank() OVER (PARTITION BY feature, repetition, held_fold ORDER BY label) + (count(*) OVER (PARTITION BY feature, repetition, held_fold, label) - 1) / 2.0E0 AS ry, attribution FROM fx_attr_rep),
arho AS (SELECT feature, repetition, held_fold, CASE WHEN min(attribution) = max(attribution) THEN NULL ELSE round(corr(rx, ry), 8) + 0.0 END AS rho FROM ar GROUP BY ALL),
aw AS (SELECT a.feature, a.repetition, a.held_fold, a.rho AS s, b.rho AS t FROM arho a JOIN arho b ON a.feature = b.feature AND a.repetition = b.repetition AND b.held_fold = (a.held_fold + 1) % 5)"""


@query("i08_flip_summary", "SELECT feature, count(*) FILTER (WHERE s * t < 0) AS flips, round(avg(s), 8) + 0.0 AS mean_source_rho, round(avg(t), 8) + 0.0 AS mean_target_rho, round(avg(t) - avg(s), 7) + 0.0 AS difference FROM aw GROUP BY ALL", ATTR, _AR)
def i08(spark, sf):
    """Every one of five folds against the next, in every repetition."""
    a = fx.attributions_by_repetition(spark, sf)
    rho = spearman(a, ["feature", "repetition", "held_fold"], "attribution", "label").select("feature", "repetition", "held_fold", rnd("rho", 8).alias("rho"))
    after = rho.select("feature", "repetition", ((F.col("held_fold") + 4) % 5).alias("held_fold"), F.col("rho").alias("t"))
    w = rho.withColumnRenamed("rho", "s").join(after, ["feature", "repetition", "held_fold"])
    return w.groupBy("feature").agg(
        count_if(F.col("s") * F.col("t") < 0).alias("flips"), rnd(F.avg("s"), 8).alias("mean_source_rho"),
        rnd(F.avg("t"), 8).alias("mean_target_rho"), rnd(F.avg("t") - F.avg("s"), 7).alias("difference"))


@query("i09_robust_median_gap", """SELECT label, feature, round(ml, 8) + 0.0 AS median_left, round(mr, 8) + 0.0 AS median_right, round(iqr, 8) + 0.0 AS pooled_iqr, CASE WHEN iqr > 0 THEN round((mr - ml) / iqr, 7) + 0.0 END AS robust_gap FROM
 (SELECT label, feature, median(value) FILTER (WHERE dataset = 'src_a') AS ml, median(value) FILTER (WHERE dataset = 'src_b') AS mr, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM fl GROUP BY ALL)""", URLS, FLONG)
def i09(spark, sf):
    g = D.median_gap(long_features(spark, sf), ["label", "feature"], "value", "dataset", "src_a", "src_b")
    return g.select("label", "feature", *[rnd(c, n).alias(c) for c, n in (("median_left", 8), ("median_right", 8), ("pooled_iqr", 8), ("robust_gap", 7))])


@query("i10_symmetric_source_auc", f"SELECT scope, feature, round(greatest(a, 1 - a), 9) + 0.0 AS source_auc_symmetric FROM (SELECT scope, feature, {AUC} AS a FROM sc GROUP BY ALL)", URLS,
       ",".join([FLONG, SC, "fy AS (SELECT scope, feature, value AS p, CASE WHEN dataset = 'src_b' THEN 1 ELSE 0 END AS label FROM fs)"]) + "," + score_ctes("fy", "scope, feature"))
def i10(spark, sf):
    out = D.side_auc(scoped(spark, sf), KEYS, "value", F.col("dataset") == "src_b")
    return out.withColumn("source_auc_symmetric", rnd("source_auc_symmetric"))


QS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


@query("i11_probability_shift", f"""SELECT a.*, w.wasserstein, js.js AS js_divergence FROM
 (SELECT repetition, model, label, {', '.join(f"round({e} FILTER (WHERE dataset = '{d}'), 8) + 0.0 AS {s}_{n}" for d, s in (('F', 'left'), ('O', 'right')) for n, e in [('mean', 'avg(p)'), ('positive_rate', 'avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END)')] + [(q, f'quantile_cont(p, {v})') for q, v in QS.items()])} FROM fx_scored GROUP BY ALL) a
 JOIN (SELECT repetition, model, label, round(sum(abs(fa - fb) * (nxt - p)), 8) + 0.0 AS wasserstein FROM (SELECT *, sum(l) OVER w / CAST(sum(l) OVER k AS DOUBLE) AS fa, sum(r) OVER w / CAST(sum(r) OVER k AS DOUBLE) AS fb, lead(p) OVER w AS nxt FROM
   (SELECT repetition, model, label, p, count(*) FILTER (WHERE dataset = 'F') AS l, count(*) FILTER (WHERE dataset = 'O') AS r FROM fx_scored GROUP BY ALL) WINDOW w AS (PARTITION BY repetition, model, label ORDER BY p), k AS (PARTITION BY repetition, model, label)) GROUP BY ALL) w USING (repetition, model, label)
 JOIN (SELECT repetition, model, label, round(js, 8) + 0.0 AS js FROM js) js USING (repetition, model, label)""", SCORED, _JS)
def i11(spark, sf):
    rows, keys = fx.scored_counts(spark, sf), ["repetition", "model", "label"]
    left = F.col("dataset") == "F"
    m = rows.groupBy(*keys).agg(*[rnd(mean(F.when(c, e), "n"), 8).alias(f"{s}_{n}") for s, c in (("left", left), ("right", ~left))
                                  for n, e in (("mean", F.col("p")), ("positive_rate", (F.col("p") >= 0.5).cast("double")))])
    q = quantiles(rows, [*keys, "dataset"], "p", QS, rows="n")
    w = q.groupBy(*keys).agg(*[rnd(F.max(F.when(F.col("dataset") == d, F.col(n))), 8).alias(f"{s}_{n}") for d, s in (("F", "left"), ("O", "right")) for n in QS])
    ws = D.two_sample(rows, keys, "p", left, "n").select(*keys, rnd("wasserstein_distance", 8).alias("wasserstein"))
    js = D.js_divergence(rows, keys, "p", left, rows="n").select(*keys, rnd("js_divergence", 8).alias("js_divergence"))
    return m.join(w, keys).join(ws, keys).join(js, keys)


@query("i12_score_summary", "SELECT dataset, model, label, count(*) AS n, round(avg(p), 9) + 0.0 AS mean, round(median(p), 9) + 0.0 AS median, round(quantile_cont(p, 0.05), 9) + 0.0 AS p05, round(quantile_cont(p, 0.95), 9) + 0.0 AS p95 FROM fx_scored GROUP BY ALL", SCORED)
def i12(spark, sf):
    rows, keys = fx.scored_counts(spark, sf), ["dataset", "model", "label"]
    a = rows.groupBy(*keys).agg(F.sum("n").alias("n"), rnd(mean("p", "n")).alias("mean"))
    q = quantiles(rows, keys, "p", {"median": 0.5, "p05": 0.05, "p95": 0.95}, rows="n")
    return a.join(q.select(*keys, *[rnd(c).alias(c) for c in ("median", "p05", "p95")]), keys)


@query("i13_top_shifted", "SELECT scope, feature, round(ks, 9) + 0.0 AS ks_statistic, r AS rank FROM (SELECT scope, feature, ks, row_number() OVER (PARTITION BY scope ORDER BY round(ks, 9) DESC, feature) AS r FROM two) WHERE r <= 5", URLS, FCT)
def i13(spark, sf):
    t = D.two_sample(scoped(spark, sf), KEYS, "value", is_left()).select(*KEYS, rnd("ks_statistic").alias("ks_statistic"))
    w = Window.partitionBy("scope").orderBy(F.col("ks_statistic").desc(), "feature")
    return t.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


@query("i14_orientation_audit", f"""SELECT dataset, model, count(*) AS runs, round(max(abs(roc_auc + inv - 1)), 6) + 0.0 AS max_identity_error, count(*) FILTER (WHERE roc_auc < 0.5) AS below_chance, count(*) FILTER (WHERE roc_auc < 0.4) AS strong_reversal
FROM runs JOIN (SELECT {RUN}, {AUC} AS inv FROM inv GROUP BY ALL) USING ({RUN}) GROUP BY ALL""", SCORED, RUNS + "," + score_ctes(name="inv", score="1 - p"))
def i14(spark, sf):
    return M.reversal_errors(fx.scored_counts(spark, sf), K, rows="n").groupBy("dataset", "model").agg(
        F.count(F.lit(1)).alias("runs"), rnd(F.max("complement_error"), 6).alias("max_identity_error"),
        count_if(F.col("roc_auc") < 0.5).alias("below_chance"), count_if(F.col("roc_auc") < 0.4).alias("strong_reversal"))


_A16 = """ro AS (SELECT dataset, predictor, x, outcome, y FROM (SELECT dataset, repetition, model, fpr AS fpr_x, accuracy AS accuracy_x, roc_auc AS roc_auc_y, macro_f1 AS macro_f1_y FROM runs) UNPIVOT (x FOR predictor IN (fpr_x, accuracy_x)) UNPIVOT (y FOR outcome IN (roc_auc_y, macro_f1_y))),
rs AS (SELECT dataset AS scope, * EXCLUDE (dataset) FROM ro UNION ALL SELECT 'all', * EXCLUDE (dataset) FROM ro),
rr AS (SELECT scope, predictor, outcome, rank() OVER (PARTITION BY scope, predictor, outcome ORDER BY x) + (count(*) OVER (PARTITION BY scope, predictor, outcome, x) - 1) / 2.0E0 AS rx, rank() OVER (PARTITION BY scope, predictor, outcome ORDER BY y) + (count(*) OVER (PARTITION BY scope, predictor, outcome, y) - 1) / 2.0E0 AS ry FROM rs)"""


@query("i16_run_association", "SELECT scope, predictor, outcome, count(*) AS n, round(corr(rx, ry), 7) + 0.0 AS rho FROM rr GROUP BY ALL", SCORED, RUNS + "," + _A16)
def i16(spark, sf):
    r = runs(spark, sf).select("dataset", "repetition", "model", F.col("fpr").alias("fpr_x"), F.col("accuracy").alias("accuracy_x"),
                               F.col("roc_auc").alias("roc_auc_y"), F.col("macro_f1").alias("macro_f1_y"))
    a = r.unpivot(["dataset", "repetition", "model", "roc_auc_y", "macro_f1_y"], ["fpr_x", "accuracy_x"], "predictor", "x")
    b = a.unpivot(["dataset", "repetition", "model", "predictor", "x"], ["roc_auc_y", "macro_f1_y"], "outcome", "y")
    out = D.run_association(b.withColumnRenamed("dataset", "scope"), [["scope"], []], ["scope"])
    return out.select("scope", "predictor", "outcome", "n", rnd("rho", 7).alias("rho"))


__all__ = ["sign_int"]
