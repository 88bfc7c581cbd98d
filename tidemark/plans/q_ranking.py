"""K: attribution, feature ranking, selection stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.columns import count_if, div, joined, rnd, sha256
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators.cumulative import hash_rank
from .metrics_sql import AUC, score_ctes
from .q_corpus import jaccard
from .registry import query

ATTR = ("attr",)
RUN = ["repetition", "held_fold"]


def summary_cte(name="sm", src="fx_attr_rep", keys="repetition, held_fold"):
    return f"""
{name}_r AS (SELECT *, rank() OVER (PARTITION BY {keys}, feature ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, feature, value) - 1) / 2.0E0 AS rx, rank() OVER (PARTITION BY {keys}, feature ORDER BY attribution) + (count(*) OVER (PARTITION BY {keys}, feature, attribution) - 1) / 2.0E0 AS ry FROM {src}),
{name}_a AS (SELECT {keys}, feature, round(avg(abs(attribution)), 12) AS mean_abs, round(avg(attribution), 12) + 0.0 AS mean_attribution, CASE WHEN min(attribution) = max(attribution) OR min(value) = max(value) THEN 0.0 ELSE round(corr(rx, ry), 9) END AS direction_correlation FROM {name}_r GROUP BY ALL),
{name} AS (SELECT *, CAST(sign(direction_correlation) AS INTEGER) AS direction_sign, rank() OVER (PARTITION BY {keys} ORDER BY mean_abs DESC) AS rank, row_number() OVER (PARTITION BY {keys} ORDER BY mean_abs DESC, feature) AS ord FROM {name}_a)"""


SM = summary_cte()
FD = SM + """,
fd0 AS (SELECT *, round(mean_abs / sum(mean_abs) OVER (PARTITION BY repetition, held_fold), 12) AS normalized_importance FROM sm),
fd AS (SELECT *, row_number() OVER (PARTITION BY repetition, held_fold ORDER BY normalized_importance DESC, feature) AS unique_rank FROM fd0)"""


def summaries(spark, sf):
    return R.global_summary(fx.attributions_by_repetition(spark, sf), RUN)


def folds(spark, sf):
    return R.fold_summary(summaries(spark, sf), RUN)


def coef():
    return ((F.col("feature") * 5) % 7 - 3) / 10.0


def coefficients(spark):
    return spark.range(35).select(F.col("id").alias("feature")).withColumn("coefficient", coef())


@query("k01_linear_attribution", """SELECT sample_id, feature, round(((feature * 5) % 7 - 3) / 10.0E0 * coalesce((value - b) / nullif(s, 0), 0), 9) + 0.0 AS attribution FROM fx_attr a
JOIN (SELECT feature, stddev_pop(value) AS s FROM fx_attr WHERE held_fold <> 0 GROUP BY ALL) USING (feature) JOIN (SELECT feature, avg(value) AS b FROM fx_attr WHERE held_fold <> 0 AND label = 0 GROUP BY ALL) USING (feature) WHERE held_fold = 0""", ATTR)
def k01(spark, sf):
    a = fx.attributions(spark, sf).drop("attribution")
    train = a.filter("held_fold <> 0")
    out = R.linear_attribution(a.filter("held_fold = 0"), train, train.filter("label = 0"), coefficients(spark))
    return out.select("sample_id", "feature", rnd("attribution").alias("attribution"))


@query("k02_global_summary", "SELECT repetition, held_fold, feature, round(mean_abs, 9) + 0.0 AS mean_abs, round(mean_attribution, 9) + 0.0 AS mean_attribution, round(direction_correlation, 7) + 0.0 AS direction_correlation, direction_sign, rank FROM sm", ATTR, SM)
def k02(spark, sf):
    return summaries(spark, sf).select(*RUN, "feature", rnd("mean_abs").alias("mean_abs"), rnd("mean_attribution").alias("mean_attribution"),
                                       rnd("direction_correlation", 7).alias("direction_correlation"), "direction_sign", "rank")


@query("k03_fold_importance", "SELECT repetition, held_fold, feature, round(normalized_importance, 9) + 0.0 AS normalized_importance, unique_rank FROM fd", ATTR, FD)
def k03(spark, sf):
    return folds(spark, sf).select(*RUN, "feature", rnd("normalized_importance").alias("normalized_importance"), "unique_rank")


@query("k04_exact_top_k", "SELECT repetition, held_fold, feature, ord AS position FROM sm WHERE ord <= 10", ATTR, SM)
def k04(spark, sf):
    return R.top_k(summaries(spark, sf), RUN, "mean_abs", 10).select(*RUN, "feature", "position")


@query("k05_full_ranking", "SELECT feature, row_number() OVER (ORDER BY round(avg(abs(attribution)), 10) DESC, feature) AS position FROM fx_attr GROUP BY feature", ATTR)
def k05(spark, sf):
    s = fx.attributions(spark, sf).groupBy("feature").agg(F.round(F.avg(F.abs("attribution")), 10).alias("score"))
    return R.top_k(s.withColumn("one", F.lit(1)), ["one"], "score", 35).select("feature", "position")


CMP = """round(count(*) FILTER (WHERE lo <= 10 AND ro <= 10) / CAST(count(*) FILTER (WHERE lo <= 10 OR ro <= 10) AS DOUBLE), 9) AS top10_jaccard, round(count(*) FILTER (WHERE lo <= 15 AND ro <= 15) / CAST(count(*) FILTER (WHERE lo <= 15 OR ro <= 15) AS DOUBLE), 9) AS top15_jaccard,
 round(count(*) FILTER (WHERE lo <= 20 AND ro <= 20) / CAST(count(*) FILTER (WHERE lo <= 20 OR ro <= 20) AS DOUBLE), 9) AS top20_jaccard, round(corr(la, ra), 7) + 0.0 AS rank_spearman, round(avg(CASE WHEN ls = rs THEN 1.0 ELSE 0.0 END), 9) AS direction_agreement_all, round(avg(CASE WHEN ls = rs THEN 1.0 ELSE 0.0 END) FILTER (WHERE lo <= 20 OR ro <= 20), 9) AS direction_agreement_top20"""


def pair_cte(name, src, same, differ):
    on = " AND ".join([f"a.{c} = b.{c}" for c in same] + ["a.feature = b.feature", f"a.{differ} < b.{differ}"])
    part = ", ".join(same) or "1"
    sel = "".join(f"a.{c}, " for c in same)
    avg = f"SELECT *, rank + (count(*) OVER (PARTITION BY {part}, {differ}, rank) - 1) / 2.0E0 AS av FROM {src}"
    return f"{name} AS (SELECT {sel}a.{differ} AS left_run, b.{differ} AS right_run, a.feature, a.ord AS lo, b.ord AS ro, a.av AS la, b.av AS ra, a.direction_sign AS ls, b.direction_sign AS rs FROM ({avg}) a JOIN ({avg}) b ON {on})"


def compared(pairs, keys):
    return R.compare_rankings(pairs, keys).withColumn("rank_spearman", rnd("rank_spearman", 7))


@query("k06_ranking_comparison", f"SELECT held_fold, left_run, right_run, {CMP} FROM pr GROUP BY ALL", ATTR, SM + "," + pair_cte("pr", "sm", ["held_fold"], "repetition"))
def k06(spark, sf):
    return compared(R.ranking_pairs(summaries(spark, sf), ["held_fold"], "repetition"), ["held_fold", "left_run", "right_run"])


_IE = "ie AS (SELECT CASE WHEN held_fold = 4 THEN 1 ELSE 0 END AS side, * FROM fx_attr_rep)," + summary_cte("si", "ie", "repetition, side") + "," + summary_cte("sl", "fx_attr_rep", "repetition, held_fold, label")
K07 = ",".join([SM, pair_cte("p1", "sm", ["held_fold"], "repetition"), pair_cte("p2", "sm", ["repetition"], "held_fold"), _IE,
                pair_cte("p3", "sl", ["repetition", "held_fold"], "label"), pair_cte("p4", "si", ["repetition"], "side")])
K07_PAIRS = f"""SELECT 'seed' AS estimand, CAST(held_fold AS VARCHAR) AS cell, left_run, right_run, {CMP} FROM p1 GROUP BY ALL UNION ALL SELECT 'partition', CAST(repetition AS VARCHAR), left_run, right_run, {CMP} FROM p2 GROUP BY ALL
UNION ALL SELECT 'regime', CAST(repetition AS VARCHAR) || ':' || CAST(held_fold AS VARCHAR), left_run, right_run, {CMP} FROM p3 GROUP BY repetition, held_fold, left_run, right_run UNION ALL SELECT 'internal_external', CAST(repetition AS VARCHAR), left_run, right_run, {CMP} FROM p4 GROUP BY ALL"""


def stability_pairs(spark, sf):
    a = fx.attributions_by_repetition(spark, sf)
    s = summaries(spark, sf)
    by_class = R.global_summary(a, [*RUN, "label"])
    side = R.global_summary(a.withColumn("side", (F.col("held_fold") == 4).cast("int")), ["repetition", "side"])
    specs = [("seed", R.ranking_pairs(s, ["held_fold"], "repetition"), F.col("held_fold").cast("string")),
             ("partition", R.ranking_pairs(s, ["repetition"], "held_fold"), F.col("repetition").cast("string")),
             ("regime", R.ranking_pairs(by_class, RUN, "label"), joined(":", "repetition", "held_fold")),
             ("internal_external", R.ranking_pairs(side, ["repetition"], "side"), F.col("repetition").cast("string"))]
    out = None
    for name, pairs, cell in specs:
        p = pairs.select(F.lit(name).alias("estimand"), cell.alias("cell"), F.col("left_run").cast("long").alias("left_run"),
                         F.col("right_run").cast("long").alias("right_run"), "left_ord", "right_ord", "left_rank", "right_rank", "left_sign", "right_sign")
        out = p if out is None else out.unionByName(p)
    return compared(out, ["estimand", "cell", "left_run", "right_run"])


@query("k07_stability_estimands", K07_PAIRS, ATTR, K07)
def k07(spark, sf):
    return stability_pairs(spark, sf)


@query("k08_stability_summary", f"SELECT estimand, count(*) AS pairs, round(avg(top10_jaccard), 8) + 0.0 AS mean_top10, round(stddev_samp(top10_jaccard), 8) + 0.0 AS sd_top10, round(median(rank_spearman), 7) + 0.0 AS median_spearman, round(min(direction_agreement_all), 8) + 0.0 AS min_direction FROM ({K07_PAIRS}) GROUP BY ALL", ATTR, K07)
def k08(spark, sf):
    return stability_pairs(spark, sf).groupBy("estimand").agg(
        F.count(F.lit(1)).alias("pairs"), rnd(F.avg("top10_jaccard"), 8).alias("mean_top10"), rnd(F.stddev_samp("top10_jaccard"), 8).alias("sd_top10"),
        rnd(F.percentile("rank_spearman", F.lit(0.5)), 7).alias("median_spearman"), rnd(F.min("direction_agreement_all"), 8).alias("min_direction"))


def stab_cte(k=10, name="st", keys="held_fold"):
    return f"""{name}0 AS (SELECT {keys}, feature, count(*) AS n_runs, count(*) FILTER (WHERE ord <= {k}) AS top_k_count, round(avg(rank), 8) + 0.0 AS mean_rank, round(stddev_samp(rank), 8) + 0.0 AS rank_sd, count(*) FILTER (WHERE direction_sign > 0) AS positive, count(*) FILTER (WHERE direction_sign < 0) AS negative FROM sm GROUP BY ALL),
{name} AS (SELECT *, round(top_k_count / CAST(n_runs AS DOUBLE), 9) AS top_k_frequency, CASE WHEN positive + negative = 0 THEN 0 WHEN negative >= positive THEN -1 ELSE 1 END AS majority_sign, round(greatest(positive, negative) / CAST(nullif(positive + negative, 0) AS DOUBLE), 9) AS direction_consistency FROM {name}0)"""


STAB = ["held_fold", "feature", "n_runs", "top_k_count", "mean_rank", "rank_sd", "top_k_frequency", "majority_sign", "direction_consistency"]


def _stab(spark, sf, k=10):
    s = R.feature_stability(summaries(spark, sf), ["held_fold"], k)
    return s.withColumns({"mean_rank": rnd("mean_rank", 8), "rank_sd": rnd("rank_sd", 8)})


@query("k09_feature_stability", f"SELECT {', '.join(STAB)} FROM st", ATTR, SM + "," + stab_cte())
def k09(spark, sf):
    return _stab(spark, sf).select(*STAB)


@query("k10_stable_set", "SELECT held_fold, feature, row_number() OVER (PARTITION BY held_fold ORDER BY top_k_frequency DESC, mean_rank, feature) AS position FROM st WHERE top_k_frequency >= 0.5 AND direction_consistency >= 0.8", ATTR, SM + "," + stab_cte())
def k10(spark, sf):
    s = R.stable_set(_stab(spark, sf), 0.5, 0.8).filter("selected")
    w = Window.partitionBy("held_fold").orderBy(F.col("top_k_frequency").desc(), "mean_rank", "feature")
    return s.select("held_fold", "feature", F.row_number().over(w).alias("position"))


@query("k11_sensitivity_grid", " UNION ALL ".join(f"SELECT {k} AS k, CAST({t} AS DOUBLE) AS tau, {str(r).lower()} AS require_direction, held_fold, count(*) AS selected FROM st{k} WHERE top_k_frequency >= {t} AND ({str(not r).lower()} OR direction_consistency >= 0.8) GROUP BY held_fold" for k in (5, 10, 15) for t in (0.5, 0.8) for r in (True, False)), ATTR, SM + "," + ",".join(stab_cte(k, f"st{k}") for k in (5, 10, 15)))
def k11(spark, sf):
    """The grid rides on the summary rows as exploded parameters: one pass for every k."""
    s = summaries(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (5, 10, 15)])))
    sg = F.col("direction_sign")
    g = s.groupBy("k", "held_fold", "feature").agg(
        div(count_if(F.col("ord") <= F.col("k")), F.count(F.lit(1))).alias("f"),
        div(F.greatest(count_if(sg > 0), count_if(sg < 0)), count_if(sg != 0)).alias("d"))
    g = g.withColumn("tau", F.explode(F.array(F.lit(0.5), F.lit(0.8)))).withColumn("require_direction", F.explode(F.array(F.lit(True), F.lit(False))))
    keep = (F.round("f", 9) >= F.col("tau")) & (~F.col("require_direction") | F.coalesce(F.round("d", 9) >= 0.8, F.lit(False)))
    return g.filter(keep).groupBy("k", "tau", "require_direction", "held_fold").agg(F.count(F.lit(1)).alias("selected"))


CS = FD + """,
cm AS (SELECT repetition, feature, median(unique_rank) AS m FROM fd GROUP BY ALL),
cs0 AS (SELECT fd.repetition, fd.feature, round(avg(normalized_importance), 12) AS importance, avg(normalized_importance) AS imp, avg(unique_rank) AS mean_rank, median(abs(unique_rank - m)) / 34.0 AS dispersion, greatest(count(*) FILTER (WHERE direction_sign = 1), count(*) FILTER (WHERE direction_sign = -1)) / 5.0E0 AS consistency,
 count(*) FILTER (WHERE unique_rank <= 10) / 5.0E0 AS t10, count(*) FILTER (WHERE unique_rank <= 15) / 5.0E0 AS t15, count(*) FILTER (WHERE unique_rank <= 20) / 5.0E0 AS t20 FROM fd JOIN cm ON fd.repetition = cm.repetition AND fd.feature = cm.feature GROUP BY ALL),
cs AS (SELECT *, round(imp * t10 * consistency * (1 - dispersion), 12) AS score_10, round(imp * t15 * consistency * (1 - dispersion), 12) AS score_15, round(imp * t20 * consistency * (1 - dispersion), 12) AS score_20,
 round(importance * t15 * (1 - dispersion), 12) AS no_direction, round(importance * t15 * consistency, 12) AS no_dispersion, round(importance * consistency * (1 - dispersion), 12) AS no_frequency FROM cs0),
cr AS (SELECT *, row_number() OVER (PARTITION BY repetition ORDER BY score_10 DESC, importance DESC, mean_rank, feature) AS rank_10, row_number() OVER (PARTITION BY repetition ORDER BY score_15 DESC, importance DESC, mean_rank, feature) AS rank_15, row_number() OVER (PARTITION BY repetition ORDER BY score_20 DESC, importance DESC, mean_rank, feature) AS rank_20 FROM cs)"""


def composite(spark, sf):
    return R.composite_scores(folds(spark, sf), ["repetition"])


@query("k12_composite_score", "SELECT repetition, feature, round(score_10, 9) + 0.0 AS score_10, round(score_15, 9) + 0.0 AS score_15, round(score_20, 9) + 0.0 AS score_20, rank_10, rank_15, rank_20, rank_15 <= 15 AS selected_15 FROM cr", ATTR, CS)
def k12(spark, sf):
    c = composite(spark, sf)
    return c.select("repetition", "feature", *[rnd(f"score_{k}").alias(f"score_{k}") for k in (10, 15, 20)], *[f"rank_{k}" for k in (10, 15, 20)],
                    (F.col("rank_15") <= 15).alias("selected_15"))


ABL = ["no_direction", "no_dispersion", "no_frequency"]


def ablation_sets(spark, sf):
    a = R.ablated_scores(composite(spark, sf)).unpivot(["repetition", "feature"], ABL, "ablation", "score")
    return R.top_k(a, ["repetition", "ablation"], "score", 15)


AB_CTE = CS + """,
ab0 AS (SELECT repetition, feature, ablation, score FROM (SELECT repetition, feature, no_direction, no_dispersion, no_frequency FROM cs) UNPIVOT (score FOR ablation IN (no_direction, no_dispersion, no_frequency))),
ab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repetition, ablation ORDER BY score DESC, feature) AS position FROM ab0) WHERE position <= 15)"""


@query("k13_ablated_scores", "SELECT repetition, ablation, feature, position, round(score, 9) + 0.0 AS score FROM ab", ATTR, AB_CTE)
def k13(spark, sf):
    return ablation_sets(spark, sf).select("repetition", "ablation", "feature", "position", rnd("score").alias("score"))


RS = "rs AS (SELECT seed, feature FROM (SELECT CAST(s AS INTEGER) AS seed, feature, row_number() OVER (PARTITION BY s ORDER BY sha256(CAST(s AS VARCHAR) || ':' || CAST(feature AS VARCHAR))) AS r FROM (SELECT DISTINCT feature FROM fx_attr), range(0, 30) AS g(s)) WHERE r <= 15)"


def random_sets(spark, sf):
    return R.random_subsets(fx.attributions(spark, sf).select("feature").distinct(), 30, 15)


@query("k14_random_subsets", "SELECT seed, array_to_string(list(feature ORDER BY feature), ',') AS features, sha256('[' || array_to_string(list(feature ORDER BY feature), ',') || ']') AS list_sha256 FROM rs GROUP BY seed", ATTR, RS)
def k14(spark, sf):
    return R.list_hash(random_sets(spark, sf), ["seed"]).withColumn("features", F.array_join(F.col("features").cast("array<string>"), ","))


@query("k15_random_baseline", """SELECT repetition, round(quantile_cont(v, 0.05), 8) + 0.0 AS q05, round(median(v), 8) + 0.0 AS median, round(quantile_cont(v, 0.95), 8) + 0.0 AS q95, round(any_value(c), 8) + 0.0 AS chosen, round(avg(CASE WHEN round(v, 9) >= round(c, 9) THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS at_least_as_good
FROM (SELECT cs.repetition, seed, sum(importance) AS v FROM rs JOIN cs ON rs.feature = cs.feature GROUP BY ALL) r JOIN (SELECT repetition, sum(importance) AS c FROM cr WHERE rank_15 <= 15 GROUP BY ALL) USING (repetition) GROUP BY ALL""", ATTR, CS + "," + RS)
def k15(spark, sf):
    c = composite(spark, sf)
    seeds = random_sets(spark, sf).join(c.select("repetition", "feature", "importance"), "feature").groupBy("repetition", "seed").agg(F.sum("importance").alias("v"))
    chosen = c.filter("rank_15 <= 15").groupBy("repetition").agg(F.sum("importance").alias("c"))
    j = seeds.join(chosen, "repetition")
    return j.groupBy("repetition").agg(
        *[rnd(F.percentile("v", F.lit(q)), 8).alias(n) for n, q in (("q05", 0.05), ("median", 0.5), ("q95", 0.95))], rnd(F.first("c"), 8).alias("chosen"),
        rnd(F.avg((F.round("v", 9) >= F.round("c", 9)).cast("double"))).alias("at_least_as_good"))


_EDGES = ", ".join(f"round(quantile_cont(value, {i / 10}), 12) AS e{i}" for i in range(1, 10))


@query("k16_binned_information", f"""SELECT feature, round(sum(n / CAST(t AS DOUBLE) * ln(n * CAST(t AS DOUBLE) / (nb * ny))), 8) + 0.0 AS mutual_information FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS ny FROM
 (SELECT feature, {' + '.join(f'CAST(value > e{i} AS INTEGER)' for i in range(1, 10))} AS bin, label, count(*) AS n FROM fx_attr JOIN (SELECT feature, {_EDGES} FROM fx_attr GROUP BY feature) USING (feature) GROUP BY ALL)) GROUP BY feature""", ATTR)
def k16(spark, sf):
    return R.binned_information(fx.attributions(spark, sf)).withColumn("mutual_information", rnd("mutual_information", 8))


_PERM = """pz AS (SELECT sample_id, label, feature, ((feature * 5) % 7 - 3) / 10.0E0 * value AS c FROM fx_attr), pb AS (SELECT sample_id, label, sum(c) AS score FROM pz GROUP BY ALL),
p1 AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY sha256('base:' || CAST(sample_id AS VARCHAR)), sample_id) AS r FROM pz),
p2 AS (SELECT sample_id, feature, CAST(s AS INTEGER) AS shuffle, c, row_number() OVER (PARTITION BY feature, s ORDER BY sha256(CAST(s AS VARCHAR) || ':' || CAST(feature AS VARCHAR) || ':' || CAST(sample_id AS VARCHAR)), sample_id) AS r FROM pz, range(0, 5) AS g(s)),
pp AS (SELECT p1.feature, p2.shuffle, p1.label, round(pb.score - p1.c + p2.c, 9) AS p FROM p1 JOIN p2 ON p1.feature = p2.feature AND p1.r = p2.r JOIN pb ON p1.sample_id = pb.sample_id),
b0 AS (SELECT 1 AS one, label, round(score, 9) AS p FROM pb),""" + score_ctes("pp", "feature, shuffle") + "," + score_ctes("b0", "one", "sb")


@query("k17_permutation_importance", f"SELECT feature, round(avg(b - a), 7) + 0.0 AS mean_drop, round(stddev_samp(b - a), 7) + 0.0 AS sd_drop FROM (SELECT feature, shuffle, {AUC} AS a FROM sc GROUP BY ALL) CROSS JOIN (SELECT {AUC} AS b FROM sb) GROUP BY feature", ATTR, _PERM)
def k17(spark, sf):
    """Shuffling a column = matching two sha256 orders of the rows; both ranks are taken in parallel blocks."""
    z = fx.attributions(spark, sf).select("sample_id", "label", "feature", (coef() * F.col("value")).alias("c"))
    base = z.groupBy("sample_id", "label").agg(F.sum("c").alias("score"))
    left = hash_rank(z.withColumn("_h", sha256(joined(":", F.lit("base"), "sample_id"))), ["feature"], "_h", ["sample_id"])
    shuffles = z.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(4))))
    right = hash_rank(shuffles.withColumn("_h", sha256(joined(":", "shuffle", "feature", "sample_id"))), ["feature", "shuffle"], "_h", ["sample_id"])
    j = left.select("sample_id", "label", "feature", "c", "_rank").join(
        right.select("feature", "shuffle", "_rank", F.col("c").alias("moved")), ["feature", "_rank"]).join(base.drop("label"), "sample_id")
    scored = j.select("feature", "shuffle", "label", F.round(F.col("score") - F.col("c") + F.col("moved"), 9).alias("p"))
    a = M.score_table(scored, ["feature", "shuffle"]).groupBy("feature", "shuffle").agg(M.roc_auc().alias("a"))
    b = M.score_table(base.select(F.lit(1).alias("one"), "label", F.round("score", 9).alias("p")), ["one"]).groupBy("one").agg(M.roc_auc().alias("b"))
    # one row: the unpermuted score's AUC
    drop = a.withColumn("one", F.lit(1)).join(F.broadcast(b), "one").withColumn("d", F.col("b") - F.col("a"))
    return drop.groupBy("feature").agg(rnd(F.avg("d"), 7).alias("mean_drop"), rnd(F.stddev_samp("d"), 7).alias("sd_drop"))


@query("k18_selection_frequency", "SELECT feature, count(*) AS selected, round(count(*) / 10.0E0, 9) + 0.0 AS frequency FROM cr WHERE rank_15 <= 15 GROUP BY feature", ATTR, CS)
def k18(spark, sf):
    return composite(spark, sf).filter("rank_15 <= 15").groupBy("feature").agg(
        F.count(F.lit(1)).alias("selected"), rnd(F.count(F.lit(1)) / 10.0).alias("frequency"))


def feature_sets(df, keys):
    return df.groupBy(*keys).agg(F.collect_set("feature").alias("s"))


_JP = "sp AS (SELECT a.repetition AS left_run, b.repetition AS right_run, count(*) AS shared FROM (SELECT * FROM cr WHERE rank_15 <= 15) a JOIN (SELECT * FROM cr WHERE rank_15 <= 15) b ON a.feature = b.feature AND a.repetition < b.repetition GROUP BY ALL)"


def set_pairs(spark, sf):
    """Runs of one selection (ten repetitions): each run meets the later ones through a list of at most ten sets."""
    s = feature_sets(composite(spark, sf).filter("rank_15 <= 15"), ["repetition"])
    runs = s.groupBy(F.lit(15).alias("k")).agg(F.array_sort(F.collect_list(F.struct("repetition", "s"))).alias("r"))
    left = runs.select("r", F.explode("r").alias("a"))
    pairs = left.select("a", F.explode(F.filter("r", lambda b: b["repetition"] > F.col("a")["repetition"])).alias("b"))
    return pairs.select(F.col("a.repetition").alias("left_run"), F.col("b.repetition").alias("right_run"),
                        jaccard(F.col("a.s"), F.col("b.s")).alias("jaccard"))


@query("k19_pair_jaccard", "SELECT left_run, right_run, round(shared / (30.0E0 - shared), 9) + 0.0 AS jaccard FROM sp", ATTR, CS + "," + _JP)
def k19(spark, sf):
    return set_pairs(spark, sf).withColumn("jaccard", rnd("jaccard"))


@query("k20_comparator_overlap", "SELECT repetition, ablation, count(*) AS shared, round(count(*) / (30.0E0 - count(*)), 9) + 0.0 AS jaccard FROM ab JOIN (SELECT repetition, feature FROM cr WHERE rank_15 <= 15) USING (repetition, feature) GROUP BY ALL", ATTR, AB_CTE)
def k20(spark, sf):
    full = feature_sets(composite(spark, sf).filter("rank_15 <= 15"), ["repetition"]).withColumnRenamed("s", "f")
    abl = feature_sets(ablation_sets(spark, sf), ["repetition", "ablation"])
    j = abl.join(full, "repetition")
    return j.select("repetition", "ablation", F.size(F.array_intersect("s", "f")).cast("long").alias("shared"), rnd(jaccard("s", "f")).alias("jaccard"))


_MEM = "mem AS (SELECT c.repetition, c.feature, importance, CASE WHEN rank_15 <= 15 AND a.feature IS NOT NULL THEN 'shared' WHEN rank_15 <= 15 THEN 'full_only' WHEN a.feature IS NOT NULL THEN 'ablated_only' ELSE 'neither' END AS membership FROM cr c LEFT JOIN (SELECT * FROM ab WHERE ablation = 'no_direction') a ON c.repetition = a.repetition AND c.feature = a.feature)"


@query("k21_membership_class", "SELECT repetition, membership, count(*) AS features, round(avg(importance), 9) + 0.0 AS mean_importance FROM mem GROUP BY ALL", ATTR, AB_CTE + "," + _MEM)
def k21(spark, sf):
    a = ablation_sets(spark, sf).filter("ablation = 'no_direction'").select("repetition", "feature", F.lit(True).alias("in_a"))
    j = composite(spark, sf).join(a, ["repetition", "feature"], "left")
    full, abl = F.col("rank_15") <= 15, F.col("in_a").isNotNull()
    m = F.when(full & abl, "shared").when(full, "full_only").when(abl, "ablated_only").otherwise("neither")
    return j.groupBy("repetition", m.alias("membership")).agg(F.count(F.lit(1)).alias("features"), rnd(F.avg("importance")).alias("mean_importance"))


@query("k22_mean_fold_jaccard", "SELECT repetition, count(*) AS pairs, round(avg(s / (30.0E0 - s)), 9) + 0.0 AS mean_jaccard FROM (SELECT a.repetition, a.held_fold, b.held_fold AS o, count(*) FILTER (WHERE a.unique_rank <= 15 AND b.unique_rank <= 15) AS s FROM fd a JOIN fd b ON a.repetition = b.repetition AND a.feature = b.feature AND a.held_fold < b.held_fold GROUP BY ALL) GROUP BY ALL", ATTR, FD)
def k22(spark, sf):
    s = feature_sets(folds(spark, sf).filter("unique_rank <= 15"), RUN)
    a = s.select("repetition", F.col("held_fold").alias("i"), F.col("s").alias("a"))
    b = s.select("repetition", F.col("held_fold").alias("o"), F.col("s").alias("b"))
    return a.join(b, "repetition").filter("i < o").groupBy("repetition").agg(F.count(F.lit(1)).alias("pairs"), rnd(F.avg(jaccard("a", "b"))).alias("mean_jaccard"))


@query("k23_component_means", "SELECT feature, round(avg(importance), 9) + 0.0 AS importance, round(avg(t15), 9) + 0.0 AS frequency, round(avg(consistency), 9) + 0.0 AS consistency, round(avg(dispersion), 9) + 0.0 AS dispersion, count(*) FILTER (WHERE rank_15 <= 15) AS selected FROM cr GROUP BY feature", ATTR, CS)
def k23(spark, sf):
    return composite(spark, sf).groupBy("feature").agg(
        rnd(F.avg("importance")).alias("importance"), rnd(F.avg("top15_frequency")).alias("frequency"), rnd(F.avg("consistency")).alias("consistency"),
        rnd(F.avg("dispersion")).alias("dispersion"), count_if(F.col("rank_15") <= 15).alias("selected")).orderBy(F.col("selected").desc(), "feature")


@query("k24_direction_conflicts", "SELECT feature, count(*) AS conflicts, count(DISTINCT left_run) AS repetitions FROM pr WHERE (lo <= 15 OR ro <= 15) AND ls * rs < 0 GROUP BY feature", ATTR, SM + "," + pair_cte("pr", "sm", ["held_fold"], "repetition"))
def k24(spark, sf):
    c = R.direction_conflicts(R.ranking_pairs(summaries(spark, sf), ["held_fold"], "repetition"))
    return c.groupBy("feature").agg(F.count(F.lit(1)).alias("conflicts"), F.count_distinct("left_run").alias("repetitions"))


_AL = """lr AS (SELECT held_fold, feature, value, rank() OVER (PARTITION BY held_fold, feature ORDER BY value) + (count(*) OVER (PARTITION BY held_fold, feature, value) - 1) / 2.0E0 AS rx, rank() OVER (PARTITION BY held_fold, feature ORDER BY label) + (count(*) OVER (PARTITION BY held_fold, feature, label) - 1) / 2.0E0 AS ry FROM fx_attr),
lrho AS (SELECT held_fold, feature, CAST(sign(round(corr(rx, ry), 9)) AS INTEGER) AS label_sign FROM lr WHERE feature % 7 <> 6 GROUP BY ALL)"""


@query("k25_direction_alignment", """SELECT repetition, held_fold, round(avg(CASE WHEN direction_sign * label_sign < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE l.feature IS NOT NULL), 9) + 0.0 AS conflict_rate_all, round(avg(CASE WHEN direction_sign * label_sign < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE l.feature IS NOT NULL AND ord <= 10), 9) + 0.0 AS conflict_rate_top10, count(*) FILTER (WHERE l.feature IS NULL) AS unmatched
FROM sm LEFT JOIN lrho l USING (held_fold, feature) GROUP BY ALL""", ATTR, SM + "," + _AL)
def k25(spark, sf):
    from ..operators.contracts import attach_indicator
    from ..operators.cumulative import spearman

    rho = spearman(fx.attributions(spark, sf).filter("feature % 7 <> 6"), ["held_fold", "feature"], "value", "label").select(
        "held_fold", "feature", F.signum(F.round("rho", 9)).cast("int").alias("label_sign"))
    j = attach_indicator(summaries(spark, sf), rho, ["held_fold", "feature"])
    bad = (F.col("direction_sign") * F.col("label_sign") < 0).cast("double")
    both = F.col("match") == "both"
    return j.groupBy(*RUN).agg(rnd(F.avg(F.when(both, bad))).alias("conflict_rate_all"), rnd(F.avg(F.when(both & (F.col("ord") <= 10), bad))).alias("conflict_rate_top10"),
                               count_if(~both).alias("unmatched"))


SIZES = [100, 500, 1000]
_CV = "cv0 AS (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY sha256('conv:' || CAST(sample_id AS VARCHAR)), sample_id) AS r FROM fx_attr), cvx AS (SELECT CAST(z AS BIGINT) AS size, c.* FROM cv0 c, (VALUES (100), (500), (1000)) AS t(z) WHERE r <= z / 2)," + summary_cte("sv", "cvx", "size")


@query("k26_cohort_convergence", f"SELECT left_run AS left_size, right_run AS right_size, {CMP} FROM pv GROUP BY ALL", ATTR, _CV + "," + pair_cte("pv", "sv", [], "size"))
def k26(spark, sf):
    a = fx.attributions(spark, sf)
    # nested samples: one rank per class serves every size, as a smaller sample is the head of a larger one
    ranked = a.withColumn("_h", sha256(F.concat(F.lit("conv:"), F.col("sample_id").cast("string"))))
    w = Window.partitionBy("feature", "label").orderBy("_h", "sample_id")
    head = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= SIZES[-1] // 2)
    parts = head.withColumn("size", F.explode(F.filter(F.array(*[F.lit(n).cast("long") for n in SIZES]), lambda z: F.col("_r") <= z / 2))).drop("_h", "_r")
    s = R.global_summary(parts, ["size"])
    return compared(R.ranking_pairs(s, [], "size"), ["left_run", "right_run"]).withColumnsRenamed({"left_run": "left_size", "right_run": "right_size"})
