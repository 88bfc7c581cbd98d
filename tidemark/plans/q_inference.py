"""L: resampling and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.columns import count_if, rnd
from ..functions.special import t_upper_tail, wilcoxon_p
from ..operators import contracts as C
from ..operators import drift as D
from ..operators import inference as I
from ..operators import metrics as M
from .metrics_sql import RUN
from .q_drift import FCT, KEYS, is_left, scoped
from .q_joins import _DELTA, _LONG, RUNS, long_runs, model_deltas, runs
from .q_metrics import _EXT, K, external_primary
from .registry import query

SCORED, URLS = ("scored",), ("urls",)
DL = ",".join([RUNS, _LONG, _DELTA.replace("max(CASE WHEN model = 'm1'", "round(max(CASE WHEN model = 'm1'").replace("'m2' THEN value END) AS delta", "'m2' THEN value END), 12) AS delta")])
GK = ["dataset", "metric"]


def deltas(spark, sf):
    return model_deltas(spark, sf).withColumn("delta", F.round("delta", 12))


@query("l01_stable_seed", "SELECT dataset, model, repetition, CAST(('0x' || substr(sha256('boot|' || dataset || '|' || model || '|' || CAST(repetition AS VARCHAR)), 9, 8)) AS BIGINT) AS seed FROM (SELECT DISTINCT dataset, model, repetition FROM fx_scored)", SCORED)
def l01(spark, sf):
    r = fx.scored(spark, sf).select("dataset", "model", "repetition").distinct()
    return r.withColumn("seed", I.stable_seed(F.lit("boot"), "dataset", "model", "repetition"))


def boot_cte(src, keys, value, order, draws, name="bm"):
    k = [x.strip() for x in keys.split(",")]
    text = " || '|' || ".join(f"CAST(v.{x} AS VARCHAR)" for x in k)
    on = " AND ".join(f"a.{x} = v.{x}" for x in k)
    return f"""{name}_v AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
{name}_d AS (SELECT {', '.join('v.' + x for x in k)}, b AS draw, CAST(('0x' || substr(sha256({text} || '|' || CAST(b AS VARCHAR) || '|' || CAST(v.i + 1 AS VARCHAR)), 1, 8)) AS UBIGINT) % n AS j FROM {name}_v v, range(1, {draws + 1}) AS g(b)),
{name} AS (SELECT {', '.join('v.' + x for x in k)}, draw, avg(a.v) AS mean FROM {name}_d v JOIN {name}_v a ON {on} AND a.i = v.j GROUP BY {', '.join('v.' + x for x in k)}, draw)"""


@query("l02_bootstrap_ci", "SELECT dataset, metric, round(quantile_cont(mean, 0.025), 9) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 9) + 0.0 AS ci_high FROM bm GROUP BY ALL", SCORED, DL + "," + boot_cte("dl", "dataset, metric", "delta", "repetition", 10000))
def l02(spark, sf):
    ci = I.bootstrap_ci(deltas(spark, sf), GK, "delta", "repetition", 10000)
    return ci.withColumns({c: rnd(c) for c in ("ci_low", "ci_high")})


@query("l03_bootstrap_distribution", "SELECT dataset, metric, draw, round(mean, 9) + 0.0 AS mean FROM bm", SCORED, DL + "," + boot_cte("dl", "dataset, metric", "delta", "repetition", 2000))
def l03(spark, sf):
    return I.bootstrap_means(deltas(spark, sf), GK, "delta", "repetition", 2000).withColumns({"mean": rnd("mean"), "draw": F.col("draw").cast("long")})


@query("l04_paired_deltas", "SELECT dataset, repetition, metric, round(delta, 9) + 0.0 AS delta FROM dl", SCORED, DL)
def l04(spark, sf):
    return deltas(spark, sf).withColumn("delta", rnd("delta"))


@query("l05_paired_summary", """SELECT a.*, b.ci_low, b.ci_high FROM (SELECT dataset, metric, count(*) AS n, round(avg(delta), 9) + 0.0 AS mean_delta, round(median(delta), 9) + 0.0 AS median_delta, count(*) FILTER (WHERE delta > 0) AS positive, count(*) FILTER (WHERE delta < 0) AS negative, count(*) FILTER (WHERE delta = 0) AS zero FROM dl GROUP BY ALL) a
JOIN (SELECT dataset, metric, round(quantile_cont(mean, 0.025), 9) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 9) + 0.0 AS ci_high FROM bm GROUP BY ALL) b USING (dataset, metric)""", SCORED, DL + "," + boot_cte("dl", "dataset, metric", "delta", "repetition", 2000))
def l05(spark, sf):
    d = deltas(spark, sf)
    ci = I.bootstrap_ci(d, GK, "delta", "repetition", 2000)
    return I.sign_summary(d, GK, "delta").join(ci, GK).withColumns({c: rnd(c) for c in ("mean_delta", "median_delta", "ci_low", "ci_high")})


@query("l06_wilcoxon_statistic", "SELECT dataset, metric, round(coalesce(sum(CASE WHEN delta > 0 THEN rk END), 0), 6) + 0.0 AS w_plus, count(rk) AS n FROM (SELECT dataset, metric, delta, CASE WHEN delta <> 0 THEN rank() OVER (PARTITION BY dataset, metric, delta <> 0 ORDER BY round(abs(delta), 12)) + (count(*) OVER (PARTITION BY dataset, metric, round(abs(delta), 12)) - 1) / 2.0E0 END AS rk FROM dl) GROUP BY ALL", SCORED, DL)
def l06(spark, sf):
    return I.wilcoxon(deltas(spark, sf), GK, "delta").select(*GK, rnd("w_plus", 6).alias("w_plus"), "n")


@query("l06_wilcoxon_p")
def l06p(spark, sf):
    w = I.wilcoxon(deltas(spark, sf), GK, "delta")
    return w.select(*GK, "w_plus", "n", rnd(wilcoxon_p("w_plus", "n", "tie_term"), 9).alias("p_value"))


_PV = "pv AS (SELECT scope, feature, round(least(1.0, 2 * exp(-2 * power(ks * sqrt(l * r / CAST(l + r AS DOUBLE)), 2))), 10) AS p FROM two JOIN (SELECT scope, count(*) FILTER (WHERE dataset = 'src_a') / 35 AS l, count(*) FILTER (WHERE dataset = 'src_b') / 35 AS r FROM fs GROUP BY ALL) USING (scope))"


@query("l07_benjamini_hochberg", """SELECT scope, feature, p, round(least(1.0, min(p * m1 / r1) OVER (ORDER BY r1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) + 0.0 AS p_all, round(least(1.0, min(p * m2 / r2) OVER (PARTITION BY scope ORDER BY r2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) + 0.0 AS p_family
FROM (SELECT *, row_number() OVER (ORDER BY p, scope, feature) AS r1, count(*) OVER () AS m1, row_number() OVER (PARTITION BY scope ORDER BY p, feature) AS r2, count(*) OVER (PARTITION BY scope) AS m2 FROM pv)""", URLS, FCT + "," + _PV)
def l07(spark, sf):
    """p-values: leading term of the Kolmogorov series over every feature and scope; one row per test."""
    t = D.two_sample(scoped(spark, sf), KEYS, "value", is_left())
    lam = F.col("ks_statistic") * F.sqrt(F.col("n_left") * F.col("n_right") / (F.col("n_left") + F.col("n_right")))
    p = t.select(*KEYS, F.lit("all").alias("family"), F.round(F.least(F.lit(1.0), 2 * F.exp(-2 * lam * lam)), 10).alias("p"))
    out = I.benjamini_hochberg(I.benjamini_hochberg(p, ["family"], "p", "p_all"), ["scope"], "p", "p_family")
    return out.select(*KEYS, "p", rnd("p_all").alias("p_all"), rnd("p_family").alias("p_family"))


_OS = "os AS (SELECT dataset, metric, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd FROM dl GROUP BY ALL)"


@query("l08_one_sample_t", "SELECT dataset, metric, n, round(mean, 9) + 0.0 AS mean, round((mean + 0.01) / (sd / sqrt(n)), 6) + 0.0 AS t_statistic, round(mean - 2.2621571627409915 * sd / sqrt(n), 9) + 0.0 AS ci_low, round(mean + 2.2621571627409915 * sd / sqrt(n), 9) + 0.0 AS ci_high, round((mean + 0.01) / sd, 6) + 0.0 AS effect FROM os", SCORED, DL + "," + _OS)
def l08(spark, sf):
    o = I.one_sample(deltas(spark, sf), GK, "delta", -0.01)
    return o.select(*GK, "n", rnd("mean").alias("mean"), rnd("t_statistic", 6).alias("t_statistic"), rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"), rnd("effect", 6).alias("effect"))


@query("l08_one_sample_p")
def l08p(spark, sf):
    o = I.one_sample(deltas(spark, sf), GK, "delta", -0.01)
    return o.select(*GK, rnd("t_statistic", 6).alias("t_statistic"), rnd(t_upper_tail("t_statistic", F.col("n") - 1.0), 9).alias("p_value"))


RHOS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9]


@query("l09_dependence_grid", "SELECT dataset, metric, rho, round(n / (1 + (n - 1) * rho), 9) + 0.0 AS effective_n, round(sd / sqrt(n / (1 + (n - 1) * rho)), 9) + 0.0 AS adjusted_se, round(mean - 2.2621571627409915 * sd / sqrt(n / (1 + (n - 1) * rho)), 9) > 0.0 AS above_margin FROM os CROSS JOIN (VALUES (0.0E0), (0.1E0), (0.25E0), (0.5E0), (0.75E0), (0.9E0)) AS t(rho)", SCORED, DL + "," + _OS)
def l09(spark, sf):
    g = I.dependence_grid(I.one_sample(deltas(spark, sf), GK, "delta", 0.0).select(*GK, "n", "mean", "sd"), RHOS, 0.0)
    return g.select(*GK, "rho", rnd("effective_n").alias("effective_n"), rnd("adjusted_se").alias("adjusted_se"), "above_margin")


_INF = f"""ti AS (SELECT {RUN}, p, pos, neg, (cum_neg - neg / 2.0) / CAST(tot_neg AS DOUBLE) AS v10, (tot_pos - cum_pos + pos / 2.0) / CAST(tot_pos AS DOUBLE) AS v01, tot_pos, tot_neg FROM tsc),
ta AS (SELECT {RUN}, sum(pos * v10) / max(tot_pos) AS auc FROM ti GROUP BY ALL),
inf AS (SELECT s.dataset, s.repetition, s.model, s.entity, s.label, CASE WHEN s.label = 1 THEN (v10 - auc) / tot_pos ELSE (v01 - auc) / tot_neg END AS influence, auc FROM fx_scored s JOIN ti ON s.dataset = ti.dataset AND s.repetition = ti.repetition AND s.model = ti.model AND s.p = ti.p JOIN ta ON s.dataset = ta.dataset AND s.repetition = ta.repetition AND s.model = ta.model WHERE split = 'test')"""


def _inf_ctes():
    from .metrics_sql import score_ctes

    return score_ctes(name="tsc", where="WHERE split = 'test'") + "," + _INF


INF = _inf_ctes()
SC = 1e6  # contributions are reported per million: they are of the order 1 / rows


@query("l10_auc_influence", f"SELECT {RUN}, label, count(*) AS n, round(sum(influence), 8) + 0.0 AS influence_sum, round(sum(influence * influence) * 1e6, 5) + 0.0 AS influence_sq, round(max(auc), 9) + 0.0 AS auc, round(max(abs(influence)) * 1e6, 4) + 0.0 AS max_influence FROM inf GROUP BY ALL", SCORED, INF)
def l10(spark, sf):
    i = I.auc_influence(fx.scored(spark, sf).filter("split = 'test'").select(*K, "entity", "label", "p"), K)
    v = F.col("influence")
    return i.groupBy(*K, "label").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(v), 8).alias("influence_sum"), rnd(F.sum(v * v) * 1e6, 5).alias("influence_sq"),
                                      rnd(F.max("auc")).alias("auc"), rnd(F.max(F.abs(v)) * 1e6, 4).alias("max_influence"))


_CL = "cl AS (SELECT dataset, repetition, entity, sum(CASE WHEN model = 'm1' THEN influence ELSE -influence END) * 1e6 AS c FROM inf GROUP BY ALL), cw AS (SELECT dataset, entity, " + ", ".join(f"coalesce(sum(c) FILTER (WHERE repetition = {r}), 0) AS r{r}" for r in range(10)) + " FROM cl GROUP BY ALL)"
RC = [f"r{i}" for i in range(10)]


def clusters(spark, sf):
    """(dataset, entity, r0..r9): influence differences of the two models summed per entity, 0 where absent."""
    e = I.entity_influence(fx.scored(spark, sf).filter("split = 'test'"), K, "entity")
    signed = F.when(F.col("model") == "m1", F.col("contribution")).otherwise(-F.col("contribution")) * SC
    return e.groupBy("dataset", "entity").agg(
        *[F.coalesce(F.sum(F.when(F.col("repetition") == i, signed)), F.lit(0.0)).alias(f"r{i}") for i in range(10)])


@query("l11_cluster_contributions", "SELECT dataset, entity, " + ", ".join(f"round({r}, 5) + 0.0 AS {r}" for r in RC) + " FROM cw", SCORED, INF + "," + _CL)
def l11(spark, sf):
    return clusters(spark, sf).withColumns({r: rnd(r, 5) for r in RC})


@query("l12_repetition_covariance", " UNION ALL ".join(f"SELECT dataset, {i} AS left_run, {j} AS right_run, round(sum(r{i} * r{j}) / 1e6, 5) + 0.0 AS covariance FROM cw GROUP BY dataset" for i in range(10) for j in range(i, 10)), SCORED, INF + "," + _CL)
def l12(spark, sf):
    return I.covariance_pairs(clusters(spark, sf), ["dataset"], RC).withColumn("covariance", rnd(F.col("covariance") / 1e6, 5))


def _cluster_evidence(spark, sf):
    cov = I.covariance_pairs(clusters(spark, sf), ["dataset"], RC).withColumn("covariance", F.col("covariance") / (SC * SC))
    s = M.score_table(fx.scored_counts(spark, sf, True).filter("split = 'test'"), K, rows="n").groupBy(*K).agg(M.roc_auc().alias("a"))
    obs = s.groupBy("dataset", F.col("repetition").alias("run")).agg(F.sum(F.when(F.col("model") == "m1", F.col("a")).otherwise(-F.col("a"))).alias("delta"))
    return I.cluster_interval(cov, obs, ["dataset"])


@query("l13_cluster_interval")
def l13(spark, sf):
    return _cluster_evidence(spark, sf)


@query("l14_entity_bootstrap")
def l14(spark, sf):
    rows = fx.scored(spark, sf).filter("repetition = 0 and split = 'test'")
    return I.entity_bootstrap(rows, ["dataset", "model"], "entity", F.lit(0.5), 2000)


_XM = f"""xm AS (SELECT dataset AS source, repetition, model, 'internal' AS side, count(*) FILTER (WHERE (p >= 0.5) = (label = 1)) / CAST(count(*) AS DOUBLE) AS accuracy, count(*) FILTER (WHERE p >= 0.5 AND label = 0) / CAST(nullif(count(*) FILTER (WHERE label = 0), 0) AS DOUBLE) AS fpr FROM fx_scored WHERE split = 'test' GROUP BY ALL
 UNION ALL SELECT source, repetition, model, 'external', count(*) FILTER (WHERE (p >= 0.5) = (label = 1)) / CAST(count(*) AS DOUBLE), count(*) FILTER (WHERE p >= 0.5 AND label = 0) / CAST(nullif(count(*) FILTER (WHERE label = 0), 0) AS DOUBLE) FROM scoped WHERE scope = 'external_primary' GROUP BY ALL)"""
XM = _EXT.strip() + "," + _XM


def transfer_metrics(spark, sf):
    """One pass counts every (run, test split or not, primary or not); the two sides are sums of those few rows."""
    rows = external_primary(spark, sf).withColumn("_test", F.col("split") == "test")
    cells = M.confusion(rows, [*K, "source", "_test", "included_in_primary"], F.lit(0.5))
    side = lambda keep, source, n: F.struct(F.col(keep).alias("keep"), F.col(source).alias("source"), F.lit(n).alias("side"))
    counts, keys = ["tp", "fp", "fn", "tn"], ["source", "repetition", "model", "side"]
    long = cells.select("repetition", "model", *counts, F.inline(F.array(
        side("_test", "dataset", "internal"), side("included_in_primary", "source", "external")))).filter("keep")
    return M.rates(long.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counts]))


@query("l15_transfer_gap", "SELECT source, repetition, model, metric, round(gap, 9) + 0.0 AS gap FROM (SELECT e.source, e.repetition, e.model, e.accuracy - i.accuracy AS accuracy, e.fpr - i.fpr AS fpr FROM xm e JOIN xm i ON e.source = i.source AND e.repetition = i.repetition AND e.model = i.model AND e.side = 'external' AND i.side = 'internal') UNPIVOT (gap FOR metric IN (accuracy, fpr))", SCORED, XM)
def l15(spark, sf):
    m = transfer_metrics(spark, sf)
    keys = ["source", "repetition", "model"]
    e = m.filter("side = 'external'").select(*keys, F.col("accuracy").alias("ea"), F.col("fpr").alias("ef"))
    i = m.filter("side = 'internal'").select(*keys, "accuracy", "fpr")
    j = C.checked_join(e, i, keys, expect="1:1", cover="left")
    out = j.select(*keys, (F.col("ea") - F.col("accuracy")).alias("accuracy"), (F.col("ef") - F.col("fpr")).alias("fpr"))
    return out.unpivot(keys, ["accuracy", "fpr"], "metric", "gap").withColumn("gap", rnd("gap"))


@query("l16_evidence_merge", "SELECT a.dataset, a.metric, round(a.mean, 9) + 0.0 AS mean, CASE WHEN a.metric = 'roc_auc' THEN c.entities END AS cluster_entities FROM os a LEFT JOIN (SELECT dataset, count(*) AS entities FROM cw GROUP BY ALL) c ON a.dataset = c.dataset", SCORED, DL + "," + _OS + "," + INF + "," + _CL)
def l16(spark, sf):
    s = I.one_sample(deltas(spark, sf), GK, "delta", 0.0).select(*GK, rnd("mean").alias("mean"))
    ev = clusters(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("cluster_entities")).withColumn("metric", F.lit("roc_auc"))
    return s.join(ev, GK, "left")


_CI = "ci AS (SELECT dataset, metric, mean, mean - 2.2621571627409915 * sd / sqrt(n) AS lo, mean + 2.2621571627409915 * sd / sqrt(n) AS hi FROM os)"


@query("l17_study_decision", "SELECT metric, bool_and(k >= 1) AS enough_in_each, bool_and(p) AS all_positive, bool_or(x) AS any_excludes_zero, bool_and(k >= 1) AND bool_or(x) AS supported FROM (SELECT metric, dataset, count(*) FILTER (WHERE mean > 0) AS k, bool_and(mean > 0) AS p, bool_or(lo > 0 OR hi < 0) AS x FROM ci GROUP BY ALL) GROUP BY metric", SCORED, DL + "," + _OS + "," + _CI)
def l17(spark, sf):
    o = I.one_sample(deltas(spark, sf), GK, "delta", 0.0)
    per = o.groupBy("metric", "dataset").agg(count_if(F.col("mean") > 0).alias("k"), F.bool_and(F.col("mean") > 0).alias("p"),
                                             F.bool_or((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("x"))
    return per.groupBy("metric").agg(
        F.bool_and(F.col("k") >= 1).alias("enough_in_each"), F.bool_and("p").alias("all_positive"), F.bool_or("x").alias("any_excludes_zero")).withColumn(
        "supported", F.col("enough_in_each") & F.col("any_excludes_zero"))


@query("l18_ci_excludes_zero", "SELECT dataset, metric, round(lo, 9) + 0.0 AS ci_low, round(hi, 9) + 0.0 AS ci_high, lo > 0 OR hi < 0 AS excludes_zero FROM ci", SCORED, DL + "," + _OS + "," + _CI)
def l18(spark, sf):
    o = I.one_sample(deltas(spark, sf), GK, "delta", 0.0)
    return o.select(*GK, rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"), ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("excludes_zero"))


__all__ = ["runs", "long_runs"]
