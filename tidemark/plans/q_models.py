"""M and the model-fitting rows of I and R, at the settings of GRID: all families, candidates and repetitions.

Fitted numbers have no SQL.  Each family of results has a ``_check`` query beside it that reduces the fitted table to
what SQL can count or what must hold (rows per cell, probabilities in range, the selection rule), with its oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import urls as U
from ..functions.columns import joined, rnd
from ..operators import corpus as O
from ..operators import metrics as M
from ..operators import models as L
from ..operators import ranking as R
from ..operators import splits as J
from ..sources.files import scratch
from .metrics_sql import F1, conf_cte
from .q_corpus import NORM, cohorts, norm
from .q_metrics import K
from .registry import query

NAMES = [f"f{i}" for i in range(35)]
RUNS = [f"r{i}" for i in range(10)]
FAMILIES = list(L.GRID)
BUDGETS = [0.01, 0.05]
SEEDS = [11, 12, 13, 14, 15]
ATTRIBUTED = 500  # rows of a held fold that are attributed, balanced over the labels

ROLE = "CASE WHEN ((entity + 13 * {r}) * 31) % 20 < 14 THEN 'train' WHEN ((entity + 13 * {r}) * 31) % 20 < 17 THEN 'validation' ELSE 'test' END"
#: DuckDB: the rows, one row per repetition with its split, and the cohort flag of the target.
STUDY_SQL = f"""m AS (SELECT vec_id AS sample_id, label % 2 AS label, vec_id % 97 AS entity,
  CASE WHEN vec_id % 3 = 0 THEN 'src_b' ELSE 'src_a' END AS dataset, vec_id % 5 AS held_fold FROM embeddings),
s AS (SELECT m.*, 'r' || t.r AS run, {ROLE.format(r="t.r")} AS split FROM m, range(10) t(r)),
used AS (SELECT DISTINCT run, entity FROM s WHERE dataset = 'src_a' AND split <> 'test'),
target AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM used WHERE used.run = s.run AND used.entity = s.entity) AS included_in_primary
  FROM s WHERE dataset = 'src_b'),
cohort AS (SELECT *, 'unfiltered' AS cohort FROM target UNION ALL SELECT *, 'primary' FROM target WHERE included_in_primary),
families AS (SELECT unnest(['lr', 'rf', 'boosted']) AS family)"""
CANDIDATES = ", ".join(f"('{f}', {i}, '{n}', {35 if f == 'lr' else p['trees']})" for f in FAMILIES for i, (n, p) in enumerate(L.GRID[f]))


def rows(spark, sf):
    """Embedding rows as a labelled corpus: 35 features, an entity and two sources."""
    return fx.spread(fx.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")).select(
        F.col("vec_id").alias("sample_id"), (F.col("label") % 2).cast("int").alias("label"), (F.col("vec_id") % 97).alias("entity"),
        F.when(F.col("vec_id") % 3 == 0, "src_b").otherwise("src_a").alias("dataset"), (F.col("vec_id") % 5).alias("held_fold"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(35)])


def role(run: str):
    return F.expr(ROLE.format(r=int(run[1:])))


def part(name: str, source: str = "src_a"):
    """Test of a run: the row belongs to that part of the source."""
    return lambda run: (F.col("dataset") == source) & (role(run) == name)


_STUDIES: dict[tuple[str, str], tuple] = {}


def study(spark, sf):
    """(designs, folder of the stored models, tuning rows) of the whole grid over ten repetitions on src_a; fitted once
    per session and table, then read back."""
    key = spark.sparkContext.applicationId, sf
    if key not in _STUDIES:
        designs = L.grid_designs(RUNS, NAMES)
        models, tuning = L.select(rows(spark, sf), designs, L.where(designs, part("train")), L.where(designs, part("validation")))
        path = scratch(spark, "study")
        L.save(spark, models, path)
        _STUDIES[key] = designs, path, tuning
    return _STUDIES[key]


def named(designs, *fields):
    """Columns of a design's attributes, from the column ``model``."""
    return [F.element_at(F.array(*[F.lit(getattr(d, f)) for d in designs]), F.col("model") + 1).alias(f) for f in fields]


def selected(spark, sf):
    """Designs and models of the winners: one per repetition and family."""
    designs, path, tuning = study(spark, sf)
    chosen = [t["model"] for t in L.winners(tuning)]
    return [designs[i] for i in chosen], L.load(spark, path, chosen), [tuning[i] for i in chosen]


def entities_used(df, runs=RUNS):
    """(run, entity) of the entities that a run's fit or tuning saw."""
    src = df.filter("dataset = 'src_a'").select("entity").distinct()
    return src.withColumn("run", F.explode(F.array(*[F.when(role(r) != "test", r) for r in runs]))).filter("run is not null")


def flagged(scored, df, runs=RUNS):
    """``scored`` (run, entity) with included_in_primary: the entity was not seen by the run."""
    return scored.join(entities_used(df, runs).withColumn("_seen", F.lit(True)), ["run", "entity"], "left").withColumn(
        "included_in_primary", F.col("_seen").isNull()).drop("_seen")


@query("m01_candidate_grid", f"""SELECT family, candidate_index, candidate, params, CASE WHEN balanced THEN n / p ELSE 1.0E0 END AS positive_weight
 FROM (VALUES {", ".join(f"('{f}', {i}, '{n}', '{str(sorted(p.items())).replace(chr(39), chr(39) * 2)}', {p['balanced']})" for f in FAMILIES for i, (n, p) in enumerate(L.GRID[f]))})
   g(family, candidate_index, candidate, params, balanced),
 (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p FROM s
  WHERE run = 'r0' AND dataset = 'src_a' AND split = 'train')""", ctes=STUDY_SQL)
def m01(spark, sf):
    n, p = L.class_counts(rows(spark, sf).filter(part("train")("r0")))
    out = [(f, i, name, str(sorted(params.items())), (n / p if params["balanced"] else 1.0)) for f in FAMILIES for i, (name, params) in enumerate(L.candidate_grid(f))]
    return spark.createDataFrame(out, "family string, candidate_index int, candidate string, params string, positive_weight double")


def _estimators(spark, sf):
    designs, path, _ = study(spark, sf)
    models = L.load(spark, path)
    scored = L.score(rows(spark, sf), models, L.where(designs, part("validation")), ["label"])
    size = F.element_at(F.array(*[F.lit(len(m.features) if d.family == "lr" else m.size) for d, m in zip(designs, models)]), F.col("model") + 1)
    return scored.select("label", "p", size.alias("size"), *named(designs, "run", "family", "candidate"))


@query("m02_estimators")
def m02(spark, sf):
    """Every candidate of every repetition: mean validation score per class."""
    return _estimators(spark, sf).groupBy("run", "family", "candidate", "label").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("p"), 6).alias("mean_score"), rnd(F.stddev_pop("p"), 6).alias("score_sd"))


@query("m02_estimators_check", f"""SELECT run, family, candidate, label, size, count(*) AS n, true AS in_range FROM s, (VALUES {CANDIDATES}) c(family, i, candidate, size)
 WHERE dataset = 'src_a' AND split = 'validation' GROUP BY ALL""", ctes=STUDY_SQL)
def m02_check(spark, sf):
    return _estimators(spark, sf).groupBy("run", "family", "candidate", "label", "size").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("in_range"))


@query("m03_select_model")
def m03(spark, sf):
    """The tuning table: ten repetitions, three families, three candidates."""
    designs, _, tuning = study(spark, sf)
    fields = ["run", "family", "candidate", "candidate_index", "params_json", "status", "error", "threshold", "macro_f1", "roc_auc", "selected"]
    return spark.createDataFrame([tuple(t[f] for f in fields) for t in tuning], "run string, family string, candidate string, candidate_index int, "
                                 "params_json string, status string, error string, threshold double, macro_f1 double, roc_auc double, selected boolean")


@query("m03_select_model_check", "SELECT 'r' || t.r AS run, family, CAST(3 AS BIGINT) AS candidates, CAST(3 AS BIGINT) AS fitted, CAST(1 AS BIGINT) AS winners, true AS rule_holds, true AS on_grid FROM range(10) t(r), families", ctes=STUDY_SQL)
def m03_check(spark, sf):
    """The winner against the table: no candidate beats it on (Macro-F1, AUC), and none before it is its equal."""
    t = m03(spark, sf)
    best = t.filter("selected").select("run", "family", F.col("macro_f1").alias("f"), F.col("roc_auc").alias("a"), F.col("candidate_index").alias("i"))
    j = t.join(best, ["run", "family"])
    worse = (F.col("macro_f1") < F.col("f")) | ((F.col("macro_f1") == F.col("f")) & (
        (F.col("roc_auc") < F.col("a")) | ((F.col("roc_auc") == F.col("a")) & (F.col("candidate_index") >= F.col("i")))))
    cents = F.col("threshold") * 100
    return j.groupBy("run", "family").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "ok").alias("fitted"), F.count_if("selected").alias("winners"),
        F.bool_and(worse).alias("rule_holds"), F.bool_and((F.abs(cents - F.round(cents)) < 1e-9) & cents.between(4.999, 95.001)).alias("on_grid"))


def _predictions(spark, sf, families=FAMILIES, keep=("sample_id", "dataset", "label", "entity", "held_fold")):
    """Scores of the winners on every row of the target, with run, family and the cohort flag."""
    designs, models, tuning = selected(spark, sf)
    df = rows(spark, sf)
    wanted = [i for i, d in enumerate(designs) if d.family in families]
    scored = L.score(df.filter("dataset = 'src_b'"), models, F.array(*[F.lit(i) for i in wanted]), list(keep))
    return flagged(scored.select(*keep, "model", "p", *named(designs, "run", "family")), df), designs, tuning


@query("m04_batch_scoring")
def m04(spark, sf):
    p, _, tuning = _predictions(spark, sf)
    threshold = F.element_at(F.array(*[F.lit(t["threshold"]) for t in tuning]), F.col("model") + 1)
    return p.select("sample_id", "run", "family", "label", rnd("p", 6).alias("probability"), (F.col("p") >= threshold).cast("int").alias("prediction"), "included_in_primary")


@query("m04_batch_scoring_check", "SELECT sample_id, label, family, included_in_primary, count(*) AS runs, true AS in_range FROM target, families GROUP BY ALL", ctes=STUDY_SQL)
def m04_check(spark, sf):
    return m04(spark, sf).groupBy("sample_id", "label", "family", "included_in_primary").agg(
        F.count(F.lit(1)).alias("runs"), F.bool_and(F.coalesce(F.col("probability").between(0, 1) & F.col("prediction").isin(0, 1), F.lit(False))).alias("in_range"))


@query("m05_frozen_evaluation")
def m05(spark, sf):
    """Threshold of the source's validation rows on the target, both cohorts, every repetition and family."""
    p, _, tuning = _predictions(spark, sf)
    threshold = F.element_at(F.array(*[F.lit(t["threshold"]) for t in tuning]), F.col("model") + 1)
    p = p.withColumns({"threshold": threshold, "cohort": cohorts(F.col("included_in_primary"))})
    return M.rates(M.confusion(p, ["run", "family", "cohort", "threshold"], F.col("threshold")))


@query("m05_frozen_evaluation_check", """SELECT run, family, cohort, CAST(sum(label) AS BIGINT) AS n_phishing, CAST(sum(1 - label) AS BIGINT) AS n_benign, true AS rates_in_range
 FROM cohort, families GROUP BY ALL""", ctes=STUDY_SQL)
def m05_check(spark, sf):
    in_range = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "macro_f1", "fpr")])
    return m05(spark, sf).select("run", "family", "cohort", (F.col("tp") + F.col("fn")).alias("n_phishing"), (F.col("tn") + F.col("fp")).alias("n_benign"), in_range.alias("rates_in_range"))


def feature_sets(df):
    """all, the 15 and 10 most informative features, an ablation without the 10, and three drawn sets of 10."""
    long = df.filter(part("train")("r0")).unpivot(["sample_id", "label"], NAMES, "feature", "value")
    info = R.binned_information(long).withColumn("mutual_information", F.round("mutual_information", 9))
    top = [r.feature for r in R.top_k(info.withColumn("one", F.lit(1)), ["one"], "mutual_information", 15).orderBy("position").select("feature").collect()]  # 15 names
    drawn = R.random_subsets(df.sparkSession.createDataFrame([(n,) for n in NAMES], "feature string"), 3, 10).select("seed", "feature").collect()  # 30 names
    return {"all": NAMES, "information15": top, "information10": top[:10], "without_information10": [n for n in NAMES if n not in top[:10]],
            **{f"random10_{s}": sorted(r.feature for r in drawn if r.seed == s) for s in range(3)}}


def _subset_study(df, sets, runs=RUNS, families=("lr",)):
    """Every feature set in every repetition, tuned over the candidates: (winning designs with set in ``run``, models, thresholds)."""
    designs = [L.Design(f"{run}/{name}", family, cand, place, params, tuple(features)) for run in runs for name, features in sets.items()
               for family in families for place, (cand, params) in enumerate(L.candidate_grid(family))]
    on = lambda name: L.where(designs, lambda key: part(name)(key.split("/")[0]))
    models, tuning = L.select(df, designs, on("train"), on("validation"))
    best = L.winners(tuning)
    return [designs[t["model"]] for t in best], [models[t["model"]] for t in best], [t["threshold"] for t in best]


def _subset_metrics(scored, designs, models, thresholds, extra=()):
    keys = F.split(F.element_at(F.array(*[F.lit(d.run) for d in designs]), F.col("model") + 1), "/")
    s = scored.select("label", "p", *extra, keys[0].alias("run"), keys[1].alias("feature_set"), *named(designs, "family"),
                      F.element_at(F.array(*[F.lit(len(m.features)) for m in models]), F.col("model") + 1).alias("n_features"),
                      F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("model") + 1).alias("threshold"))
    return M.metric_table(s, ["run", "feature_set", "family", "n_features", "threshold", *extra], F.col("threshold"))


@query("m06_feature_subsets")
def m06(spark, sf):
    df = rows(spark, sf)
    designs, models, thresholds = _subset_study(df, feature_sets(df))
    return _subset_metrics(L.score(df, models, L.where(designs, lambda key: part("test")(key.split("/")[0])), ["label"]), designs, models, thresholds)


SETS_SQL = "(VALUES ('all', 35), ('information15', 15), ('information10', 10), ('without_information10', 25), ('random10_0', 10), ('random10_1', 10), ('random10_2', 10)) f(feature_set, n_features)"


@query("m06_feature_subsets_check", f"""SELECT run, feature_set, n_features, CAST(sum(label) AS BIGINT) AS n_phishing, CAST(sum(1 - label) AS BIGINT) AS n_benign, true AS in_range
 FROM s, {SETS_SQL} WHERE dataset = 'src_a' AND split = 'test' GROUP BY ALL""", ctes=STUDY_SQL)
def m06_check(spark, sf):
    return m06(spark, sf).select("run", "feature_set", "n_features", (F.col("tp") + F.col("fn")).alias("n_phishing"), (F.col("tn") + F.col("fp")).alias("n_benign"),
                                 (F.col("roc_auc").between(0, 1) & F.col("brier").between(0, 1)).alias("in_range"))


@query("m07_held_fold_diagnostics")
def m07(spark, sf):
    """Every family's first candidate, each of five folds held out, at the threshold 0.5; spread of the metrics over the folds."""
    df = rows(spark, sf)
    designs = [L.Design(f"h{h}", family, *L.candidate_grid(family)[0][:1], 0, L.candidate_grid(family)[0][1], tuple(NAMES)) for h in range(5) for family in FAMILIES]
    models = L.fit(df, designs, L.where(designs, lambda h: F.col("held_fold") != int(h[1:])))
    s = L.score(df, models, L.where(designs, lambda h: F.col("held_fold") == int(h[1:])), ["label", "held_fold"])
    m = M.metric_table(s.select("held_fold", "label", "p", *named(designs, "family")), ["family", "held_fold"], F.lit(0.5))
    spread = m.groupBy("family").agg(*[rnd(F.stddev_samp(c), 6).alias(f"{c}_sd") for c in ("macro_f1", "roc_auc", "fpr")])
    return m.join(spread, "family").select("family", "held_fold", "n_samples", *[rnd(c, 6).alias(c) for c in ("macro_f1", "roc_auc", "fpr")], "macro_f1_sd", "roc_auc_sd", "fpr_sd")


@query("m07_held_fold_diagnostics_check", "SELECT family, held_fold, count(*) AS n_samples, true AS in_range FROM m, families GROUP BY ALL", ctes=STUDY_SQL)
def m07_check(spark, sf):
    ok = F.col("macro_f1").between(0, 1) & F.col("roc_auc").between(0, 1) & F.col("fpr").between(0, 1) & (F.col("roc_auc_sd") >= 0)
    return m07(spark, sf).select("family", "held_fold", "n_samples", ok.alias("in_range"))


@query("m08_reciprocal_transfer")
def m08(spark, sf):
    """Winners of ten repetitions and three families on four target views x two cohorts x three thresholds x two weightings."""
    p, designs, tuning = _predictions(spark, sf)
    validation = L.score(rows(spark, sf), selected(spark, sf)[1], L.where(designs, part("validation")), ["label"])
    budget = M.budget_threshold(M.score_table(validation, ["model"]), ["model"], BUDGETS).select(
        "model", F.concat(F.lit("fpr_"), F.col("budget").cast("string")).alias("rule"), "threshold")
    grid = spark.createDataFrame([(i, "grid", t["threshold"]) for i, t in enumerate(tuning)], "model int, rule string, threshold double")
    target = p.withColumns({"view": F.concat(F.lit("view"), (F.col("held_fold") % 4).cast("string")), "cohort": cohorts(F.col("included_in_primary"))})
    j = target.join(grid.unionByName(budget), "model")  # three thresholds per model
    keys = ["run", "family", "view", "cohort", "rule", "threshold"]
    per = M.confusion(j, [*keys, "entity"], F.col("threshold"))
    counts = ["tp", "fp", "fn", "tn"]
    size = sum((F.col(c) for c in counts[1:]), F.col("tp"))
    both = per.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in counts], *[F.sum(F.try_divide(F.col(c).cast("double"), size)).alias(f"e_{c}") for c in counts])
    weighted = both.select(*keys, F.inline(F.array(F.struct(F.lit("row").alias("weighting"), *counts), F.struct(F.lit("entity").alias("weighting"), *[F.col(f"e_{c}").alias(c) for c in counts]))))
    return M.rates(weighted)


@query("m08_reciprocal_transfer_check", """SELECT run, family, 'view' || (held_fold % 4) AS view, cohort, rule, CAST(count(*) AS DOUBLE) AS row_sum, CAST(count(DISTINCT entity) AS DOUBLE) AS entity_sum
 FROM cohort, families, (VALUES ('grid'), ('fpr_0.01'), ('fpr_0.05')) g(rule) GROUP BY ALL""", ctes=STUDY_SQL)
def m08_check(spark, sf):
    """Each cell's confusion adds up to its rows, and to its entities where entities weigh alike."""
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return m08(spark, sf).groupBy("run", "family", "view", "cohort", "rule").agg(
        rnd(F.max(F.when(F.col("weighting") == "row", total)), 6).alias("row_sum"), rnd(F.max(F.when(F.col("weighting") == "entity", total)), 6).alias("entity_sum"))


@query("m09_selected_candidates", f"SELECT dataset, model AS selected, count(*) AS runs FROM (SELECT dataset, repetition, model, row_number() OVER (PARTITION BY dataset, repetition ORDER BY round({F1}, 12) DESC, model) AS r FROM conf) WHERE r = 1 GROUP BY ALL", ("scored",), conf_cte(where="WHERE split = 'validation'"))
def m09(spark, sf):
    c = M.rates(M.confusion(fx.scored_counts(spark, sf, True).filter("split = 'validation'"), K, F.lit(0.5), rows="n"))
    best = c.groupBy("dataset", "repetition").agg(F.min(F.struct((-F.round("macro_f1", 12)).alias("f"), "model")).alias("b"))
    return best.groupBy("dataset", F.col("b.model").alias("selected")).agg(F.count(F.lit(1)).alias("runs"))


@query("m10_model_reuse", "SELECT run, family, count(*) AS n, 0.0E0 AS max_difference FROM s, families WHERE dataset = 'src_a' AND split = 'validation' GROUP BY ALL", ctes=STUDY_SQL)
def m10(spark, sf):
    designs, models, _ = selected(spark, sf)
    path = scratch(spark, "model")
    L.save(spark, models, path)
    which = L.where(designs, part("validation"))
    a = L.score(rows(spark, sf), models, which, ["sample_id"])
    b = L.score(rows(spark, sf), L.load(spark, path), which, ["sample_id"]).withColumnRenamed("p", "q")
    j = a.join(b, ["sample_id", "model"]).select("p", "q", *named(designs, "run", "family"))
    return j.groupBy("run", "family").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_difference"))


def _discrimination(spark, sf):
    df = rows(spark, sf).withColumn("source_id", (F.col("dataset") == "src_b").cast("int")).select("sample_id", "label", "source_id", "entity", *NAMES)
    return L.source_discrimination(df, NAMES, "entity", SEEDS)


@query("i15_source_discrimination")
def i15(spark, sf):
    return _discrimination(spark, sf).withColumn("auc", rnd("auc", 6))


@query("i15_source_discrimination_check", f"""SELECT label AS class_label, CAST(seed AS INTEGER) AS seed, count(*) FILTER (WHERE dataset = 'src_a') AS test_left, count(*) FILTER (WHERE dataset = 'src_b') AS test_right, true AS in_range
 FROM m, (VALUES {", ".join(f"({s})" for s in SEEDS)}) d(seed) WHERE CAST('0x' || substr(sha256('sd' || seed || ':' || entity), 1, 8) AS BIGINT) / 4294967296.0E0 < 0.25 GROUP BY ALL""", ctes=STUDY_SQL)
def i15_check(spark, sf):
    return _discrimination(spark, sf).select("class_label", "seed", "test_left", "test_right", F.col("auc").between(0, 1).alias("in_range"))


# ------------------------------------------------------------------ model-fitting compositions of R
def _attributions(spark, sf):
    """Per repetition and held fold: a logistic fit on the other four folds and its attributions on a balanced sample of the fifth."""
    df = rows(spark, sf).filter("dataset = 'src_a'").select("sample_id", "label", "entity", *NAMES)
    ten = df.withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS]))).filter(
        reduce(lambda a, b: a | b, [(F.col("run") == r) & (role(r) == "train") for r in RUNS]))
    path = scratch(spark, "folds")
    J.group_folds(ten, ["run"], "entity", joined(":", F.lit("r12"), "run"), 5).write.parquet(path)
    folds = spark.read.parquet(path)
    keys = [(r, h) for r in RUNS for h in range(5)]
    designs = [L.Design(f"{r}/{h}", "lr", "lr_c1", 1, L.GRID["lr"][1][1], tuple(NAMES)) for r, h in keys]
    place = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(RUNS) for x in (r, 5 * i)]), F.col("run"))
    fits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda h: h != F.col("fold")), lambda h: (place + h).cast("int"))
    models = L.fit(folds, designs, fits)
    coef = L.coefficients(spark, models, [d.run for d in designs]).select(
        F.split("run", "/")[0].alias("run"), F.split("run", "/")[1].cast("int").alias("held_fold"), "feature", "coefficient")
    # mean of the training rows of each fit: sums per fold once, then all folds less the held one
    sums = folds.unpivot(["run", "fold"], NAMES, "feature", "value").groupBy("run", "fold", "feature").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    whole = sums.groupBy("run", "feature").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    centre = sums.join(whole, ["run", "feature"]).select("run", F.col("fold").alias("held_fold"), "feature", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("centre"))
    held = J.balanced_hash_sample(folds.withColumnRenamed("fold", "held_fold"), ["run", "held_fold"], ATTRIBUTED, "held")
    long = held.unpivot(["run", "held_fold", "sample_id", "label"], NAMES, "feature", "value")
    side = coef.join(centre, ["run", "held_fold", "feature"])
    return long.join(side, ["run", "held_fold", "feature"]).withColumn("attribution", F.col("coefficient") * (F.col("value") - F.col("centre"))), folds


@query("r12_fold_attribution_run")
def r12(spark, sf):
    """Ten repetitions x five held folds; sample and fit entities are disjoint by fold."""
    a, _ = _attributions(spark, sf)
    keys = ["run", "held_fold"]
    s = R.fold_summary(R.global_summary(a, keys), keys)
    return s.select("run", "held_fold", "feature", rnd("normalized_importance", 6).alias("normalized_importance"), "direction_sign", "unique_rank")


@query("r12_fold_attribution_check", "SELECT 'r' || t.r AS run, CAST(h AS INTEGER) AS held_fold, CAST(35 AS BIGINT) AS features, true AS ranks_complete, true AS shares_sum, true AS balanced, CAST(0 AS BIGINT) AS leaked FROM range(10) t(r), range(5) u(h)")
def r12_check(spark, sf):
    """Ranks are 1..35, shares add to one, the sample takes min(class, half) of either label, no entity is in fold and rest."""
    a, folds = _attributions(spark, sf)
    keys = ["run", "held_fold"]
    s = R.fold_summary(R.global_summary(a, keys), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("features"), (F.sum("unique_rank") == 35 * 36 // 2).alias("ranks_complete"), (F.abs(F.sum("normalized_importance") - 1) < 1e-6).alias("shares_sum"))
    have = folds.groupBy("run", F.col("fold").alias("held_fold"), "label").agg(F.count(F.lit(1)).alias("n"))
    took = a.filter("feature = 'f0'").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("k"))
    balanced = have.join(took, [*keys, "label"], "left").groupBy(*keys).agg(
        F.bool_and(F.coalesce("k", F.lit(0)) == F.least("n", F.lit(ATTRIBUTED // 2))).alias("balanced"))
    split = folds.groupBy("run", "entity").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).groupBy("run").agg(F.count_if(F.col("a") != F.col("b")).alias("leaked"))
    return s.join(balanced, keys).join(split, "run").withColumn("held_fold", F.col("held_fold").cast("int"))


def _corpus_models(cut):
    """Tuned models of every family on each corpus of ``cut`` (corpus, split, features), metrics on its test rows."""
    path = scratch(cut.sparkSession, "corpora")
    cut.write.parquet(path)
    df = cut.sparkSession.read.parquet(path)
    runs = sorted(r.corpus for r in df.select("corpus").distinct().collect())  # the corpora of one query
    designs = L.grid_designs(runs, U.FEATURE_NAMES)
    on = lambda name: L.where(designs, lambda run: (F.col("corpus") == run) & (F.col("split") == name))
    models, tuning = L.select(df, designs, on("train"), on("validation"))
    best = L.winners(tuning)
    chosen, fitted = [designs[t["model"]] for t in best], [models[t["model"]] for t in best]
    s = L.score(df, fitted, L.where(chosen, lambda run: (F.col("corpus") == run) & (F.col("split") == "test")), ["label"])
    threshold = F.element_at(F.array(*[F.lit(t["threshold"]) for t in best]), F.col("model") + 1)
    s = s.select("label", "p", *named(chosen, "run", "family", "candidate"), threshold.alias("threshold")).withColumnRenamed("run", "corpus")
    return M.metric_table(s, ["corpus", "family", "candidate", "threshold"], F.col("threshold"))


def as_doubles():
    return [F.col(n).cast("double").alias(n) for n in U.FEATURE_NAMES]


def _retraining(spark, sf):
    n = norm(spark, sf)
    out = None
    for tag, corpus in (("master", O.master_corpus(n)), ("dedup", O.deduplicated_corpus(n))):
        features = O.feature_table(corpus.select("dataset", "source_row", "raw_url", "label"), fx.rules(spark), tag)
        cut = J.row_stratified(features, ["corpus_version"], "source_row", F.lit(tag)).select(
            F.lit(tag).alias("corpus"), F.concat(F.lit(f"{tag}:"), F.col("source_row").cast("string")).alias("sample_id"), "label", "split", *as_doubles())
        out = cut if out is None else out.unionByName(cut)
    return _corpus_models(out)


TEST_ROWS = """SELECT '{tag}' AS corpus, CAST(sum(label) AS BIGINT) AS n_phishing, CAST(sum(1 - label) AS BIGINT) AS n_benign FROM (
  SELECT label, row_number() OVER (PARTITION BY {keys} ORDER BY sha256('{seed}:' || CAST(source_row AS VARCHAR)), source_row) AS r,
         count(*) OVER (PARTITION BY {keys}) AS t, source_row FROM {src}) WHERE r > floor(t * 0.85 + 1e-9)"""


def _sizes(m):
    return m.select("corpus", "family", (F.col("tp") + F.col("fn")).alias("n_phishing"), (F.col("tn") + F.col("fp")).alias("n_benign"),
                    (F.col("roc_auc").between(0, 1) & F.col("macro_f1").between(0, 1)).alias("in_range"))


@query("r16_deduplicated_retraining")
def r16(spark, sf):
    return _retraining(spark, sf)


@query("r16_deduplicated_retraining_check", f"""SELECT corpus, family, n_phishing, n_benign, true AS in_range FROM (
 {TEST_ROWS.format(tag="master", seed="master", keys="label", src="master")} UNION ALL {TEST_ROWS.format(tag="dedup", seed="dedup", keys="label", src="dedup")}),
 (SELECT unnest(['lr', 'rf', 'boosted']) AS family)""", ("urls",), NORM)
def r16_check(spark, sf):
    return _sizes(_retraining(spark, sf))


def _fixed_roles(spark, sf):
    """Roles drawn on the master corpus, carried onto the deduplicated rows, models trained there."""
    master = O.master_corpus(norm(spark, sf))
    roles = J.row_stratified(master.select("dataset", "source_row", "label"), ["dataset"], "source_row", F.lit("m")).select("source_row", "split")
    dedup = O.first_per_key(master, ["dataset", "normalized_url_sha256"], ["source_row"])
    f = U.url_features(dedup.select("source_row", "raw_url", "label"), fx.rules(spark)).join(roles, "source_row")
    return _corpus_models(f.select(F.lit("fixed_role").alias("corpus"), F.col("source_row").alias("sample_id"), "label", "split", *as_doubles()))


@query("r17_fixed_role_retraining")
def r17(spark, sf):
    return _fixed_roles(spark, sf)


@query("r17_fixed_role_retraining_check", """SELECT 'fixed_role' AS corpus, family, CAST(sum(label) AS BIGINT) AS n_phishing, CAST(sum(1 - label) AS BIGINT) AS n_benign, true AS in_range
 FROM dedup JOIN (SELECT source_row FROM (SELECT source_row, row_number() OVER (PARTITION BY dataset, label ORDER BY sha256('m:' || CAST(source_row AS VARCHAR)), source_row) AS r,
   count(*) OVER (PARTITION BY dataset, label) AS t FROM master) WHERE r > floor(t * 0.85 + 1e-9)) USING (source_row), (SELECT unnest(['lr', 'rf', 'boosted']) AS family) GROUP BY ALL""", ("urls",), NORM)
def r17_check(spark, sf):
    return _sizes(_fixed_roles(spark, sf))


METHODS = ["all", "information15", "information10"]


def _methods(spark, sf):
    """Frozen methods of every repetition on the target: (scored rows with the cohort flag, designs, models, thresholds)."""
    df = rows(spark, sf)
    sets = {k: v for k, v in feature_sets(df).items() if k in METHODS}
    designs, models, thresholds = _subset_study(df, sets)
    keep = ["sample_id", "label", "entity"]
    run = F.split(F.element_at(F.array(*[F.lit(d.run) for d in designs]), F.col("model") + 1), "/")[0]
    scored = L.score(df.filter("dataset = 'src_b'"), models, None, keep).withColumn("run", run)
    return flagged(scored, df), designs, models, thresholds


@query("r19_multi_method_evaluation")
def r19(spark, sf):
    """All threshold and ranking metrics of every method, repetition and cohort."""
    scored, designs, models, thresholds = _methods(spark, sf)
    scored = scored.drop("run").withColumn("cohort", cohorts(F.col("included_in_primary")))
    return _subset_metrics(scored, designs, models, thresholds, ("cohort",))


@query("r19_multi_method_check", """SELECT run, feature_set, cohort, CAST(sum(label) AS BIGINT) AS n_phishing, CAST(sum(1 - label) AS BIGINT) AS n_benign, true AS in_range
 FROM cohort, (VALUES ('all'), ('information15'), ('information10')) f(feature_set) GROUP BY ALL""", ctes=STUDY_SQL)
def r19_check(spark, sf):
    return r19(spark, sf).select("run", "feature_set", "cohort", (F.col("tp") + F.col("fn")).alias("n_phishing"), (F.col("tn") + F.col("fp")).alias("n_benign"),
                                 (F.coalesce(F.col("roc_auc"), F.lit(0.5)).between(0, 1) & F.col("brier").between(0, 1)).alias("in_range"))


@query("r19_wide_scores")
def r19_wide(spark, sf):
    """Selected methods' scores side by side, one row per target row and repetition, with the cohort flag."""
    scored, designs, _, _ = _methods(spark, sf)
    method = F.split(F.element_at(F.array(*[F.lit(d.run) for d in designs]), F.col("model") + 1), "/")[1]
    return scored.withColumn("method", method).groupBy("run", "sample_id", "label", "included_in_primary").pivot(
        "method", ["all", "information15"]).agg(rnd(F.first("p"), 6))


@query("r19_wide_scores_check", "SELECT run, sample_id, label, included_in_primary, true AS complete FROM target", ctes=STUDY_SQL)
def r19_wide_check(spark, sf):
    return r19_wide(spark, sf).select("run", "sample_id", "label", "included_in_primary", (F.col("all").between(0, 1) & F.col("information15").between(0, 1)).alias("complete"))


@query("r21_selector_retraining")
def r21(spark, sf):
    """Retrained selectors: metrics on the source's test rows and on the target, every repetition."""
    df = rows(spark, sf)
    sets = feature_sets(df)
    designs, models, thresholds = _subset_study(df, {k: sets[k] for k in ("all", "information10")})
    inside = L.score(df, models, L.where(designs, lambda key: part("test")(key.split("/")[0])), ["label"]).withColumn("scope", F.lit("internal"))
    outside = L.score(df.filter("dataset = 'src_b'"), models, None, ["label"]).withColumn("scope", F.lit("external"))
    return _subset_metrics(inside.unionByName(outside), designs, models, thresholds, ("scope",))


@query("r21_selector_retraining_check", """SELECT run, feature_set, scope, CAST(sum(label) AS BIGINT) AS n_phishing, CAST(sum(1 - label) AS BIGINT) AS n_benign, true AS in_range
 FROM (SELECT run, label, 'internal' AS scope FROM s WHERE dataset = 'src_a' AND split = 'test' UNION ALL SELECT run, label, 'external' FROM target),
 (VALUES ('all'), ('information10')) f(feature_set) GROUP BY ALL""", ctes=STUDY_SQL)
def r21_check(spark, sf):
    return r21(spark, sf).select("run", "feature_set", "scope", (F.col("tp") + F.col("fn")).alias("n_phishing"), (F.col("tn") + F.col("fp")).alias("n_benign"),
                                 (F.col("roc_auc").between(0, 1) & F.col("brier").between(0, 1)).alias("in_range"))


@query("r26_model_reconstruction", "SELECT family, true AS same_candidate, 0.0E0 AS threshold_difference, 0.0E0 AS max_difference, count(*) AS n FROM s, families WHERE run = 'r0' AND dataset = 'src_a' AND split = 'test' GROUP BY ALL", ctes=STUDY_SQL)
def r26(spark, sf):
    """Every family of the first repetition fitted and tuned again, against the stored winners."""
    designs, models, tuning = selected(spark, sf)
    first = [i for i, d in enumerate(designs) if d.run == "r0"]
    again = L.grid_designs(["r0"], NAMES)
    df = rows(spark, sf)
    refitted, retuned = L.select(df, again, L.where(again, part("train")), L.where(again, part("validation")))
    best = L.winners(retuned)
    which = L.where([designs[i] for i in first], part("test"))
    a = L.score(df, [models[i] for i in first], which, ["sample_id"])
    b = L.score(df, [refitted[t["model"]] for t in best], which, ["sample_id"]).withColumnRenamed("p", "q")
    about = spark.createDataFrame([(k, designs[i].family, designs[i].candidate == t["candidate"], round(abs(tuning[i]["threshold"] - t["threshold"]), 9))
                                   for k, (i, t) in enumerate(zip(first, best))], "model int, family string, same_candidate boolean, threshold_difference double")
    j = a.join(b, ["sample_id", "model"]).groupBy("model").agg(rnd(F.max(F.abs(F.col("p") - F.col("q")))).alias("max_difference"), F.count(F.lit(1)).alias("n"))
    return about.join(j, "model").drop("model")
