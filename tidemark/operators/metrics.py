"""Classifier metrics, thresholds and calibration (H), grouped by run keys instead of looped.

``score_table`` reduces predictions to one row per (keys, score) with class counts (or weights) and
running sums; every ranking metric and threshold rule is an aggregate of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import counted, div, ratio
from .cumulative import cumulative_by_key
from .skew import with_group_stats

Z95 = 1.6448536269514722  # fixed value: one-sided 95 % normal quantile


def score_table(df: DataFrame, keys: list[str], score: str = "p", label: str = "label", weight: str | None = None,
                block_rows: int | None = None, rows: str | None = None) -> DataFrame:
    """Per (keys, score): pos, neg, ascending running sums, totals, and counts at or above the score.
    ``weight`` names real weights, ``rows`` the number of rows that a row stands for."""
    w = F.col(weight or rows) if weight or rows else F.lit(1)
    out = cumulative_by_key(df, keys, score, {
        "pos": F.sum(F.when(F.col(label) == 1, w).otherwise(0 if not weight else 0.0)),
        "neg": F.sum(F.when(F.col(label) == 0, w).otherwise(0 if not weight else 0.0))}, block_rows)
    return out.withColumns({
        "tp_at": F.col("tot_pos") - F.col("cum_pos") + F.col("pos"),
        "fp_at": F.col("tot_neg") - F.col("cum_neg") + F.col("neg"),
    })


def auc_terms() -> Column:
    return F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))


def roc_auc() -> Column:
    """Aggregate over a score table; ties count half; NULL without both classes."""
    return div(auc_terms(), F.max("tot_pos") * F.max("tot_neg").cast("double"))


def pr_auc() -> Column:
    return F.sum(div("pos", "tot_pos") * ratio("tp_at", F.col("tp_at") + F.col("fp_at")))


def inverted_auc() -> Column:
    """AUC of the reversed score: negatives that lie above each positive."""
    above = F.sum(F.col("pos") * (F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2.0))
    return div(above, F.max("tot_pos") * F.max("tot_neg").cast("double"))


def reversal_errors(df: DataFrame, keys: list[str], rows: str | None = None) -> DataFrame:
    """AUC on p, on 1 - p and on -p, each ranked by itself (1 - p may tie scores that p keeps apart), and how far the
    sums of the first with either of the others are from one."""
    kinds = [("roc_auc", F.col("p")), ("inverted_auc", 1 - F.col("p")), ("negated_auc", -F.col("p"))]
    kept = [*keys, "label", *([rows] if rows else [])]
    each = df.select(*kept, F.inline(F.array(*[F.struct(F.lit(n).alias("_kind"), s.alias("p")) for n, s in kinds])))
    auc = score_table(each, [*keys, "_kind"], rows=rows).groupBy(*keys, "_kind").agg(roc_auc().alias("auc"))
    out = auc.groupBy(*keys).agg(*[F.max(F.when(F.col("_kind") == n, F.col("auc"))).alias(n) for n, _ in kinds])
    return out.withColumns({"complement_error": F.abs(F.col("roc_auc") + F.col("inverted_auc") - 1),
                            "negation_error": F.abs(F.col("roc_auc") + F.col("negated_auc") - 1)})


def f1_macro(tp, fp, fn, tn) -> Column:
    return (ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fn + fp)) / 2.0


def confusion(df: DataFrame, keys: list[str], threshold: Column, weight: Column | None = None, rows: str | None = None) -> DataFrame:
    """tp, fp, fn, tn with prediction = score >= threshold."""
    hit, y, w = F.col("p") >= threshold, F.col("label"), weight
    one = (lambda c: counted(c, rows)) if w is None else (lambda c: F.sum(F.when(c, w).otherwise(0.0)))
    return df.groupBy(*keys).agg(
        one(hit & (y == 1)).alias("tp"), one(hit & (y == 0)).alias("fp"),
        one(~hit & (y == 1)).alias("fn"), one(~hit & (y == 0)).alias("tn"))


def rates(conf: DataFrame) -> DataFrame:
    """The threshold metrics of a confusion table."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return conf.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0,
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "macro_f1": f1_macro(tp, fp, fn, tn),
        "fpr": div(fp, fp + tn),
    })


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))


def log_loss_row() -> Column:
    q = clipped(F.col("p"))
    return F.when(F.col("label") == 1, -F.ln(q)).otherwise(-F.ln(1 - q))


def metric_table(df: DataFrame, keys: list[str], threshold: Column, block_rows: int | None = None, rows: str | None = None) -> DataFrame:
    """Every metric of a run from one score table: a single pre-aggregation serves all of them."""
    s = score_table(df, keys, block_rows=block_rows, rows=rows)
    hit, q = F.col("p") >= threshold, clipped(F.col("p"))
    n = F.max(F.col("tot_pos") + F.col("tot_neg"))
    out = s.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        n.alias("n_samples"), F.max("tot_neg").alias("n_benign"), F.max("tot_pos").alias("n_phishing"),
        roc_auc().alias("roc_auc"), inverted_auc().alias("inverted_auc"), pr_auc().alias("pr_auc"),
        div(F.sum(F.col("pos") * F.pow(F.col("p") - 1, F.lit(2)) + F.col("neg") * F.pow("p", F.lit(2))), n).alias("brier"),
        div(F.sum(-F.col("pos") * F.ln(q) - F.col("neg") * F.ln(1 - q)), n).alias("log_loss"),
    )
    return rates(out)


def grid_threshold(df: DataFrame, keys: list[str], rows: str | None = None) -> DataFrame:
    """Best Macro-F1 on the grid 0.05 .. 0.95: tie to the threshold nearest 0.5, then the smaller.

    Scores fall into the highest grid step they reach (91 buckets per key), so the sweep is a suffix
    sum over at most 92 rows per key whatever the row count.
    """
    cents = F.when(F.col("p") >= 0.95, 95).otherwise(F.floor(F.col("p") * 100).cast("int"))
    # floor(p*100) may be off by one against the decimal grid; settle with exact comparisons
    cents = F.when((cents < 95) & (F.col("p") >= (cents + 1) / F.lit(100.0)), cents + 1).when(
        F.col("p") < cents / F.lit(100.0), cents - 1).otherwise(cents)
    b = df.withColumn("_c", F.greatest(cents, F.lit(4))).groupBy(*keys, "_c").agg(
        counted(F.col("label") == 1, rows).alias("pos"), counted(F.col("label") == 0, rows).alias("neg"))
    grid = b.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                F.map_from_entries(F.collect_list(F.struct("_c", F.struct("pos", "neg")))).alias("m"))
    grid = grid.withColumn("_t", F.explode(F.sequence(F.lit(4), F.lit(95))))
    zero = F.lit(0).cast("long")
    grid = grid.withColumns({"pos": F.coalesce(F.try_element_at("m", F.col("_t"))["pos"], zero),
                             "neg": F.coalesce(F.try_element_at("m", F.col("_t"))["neg"], zero)})
    above = Window.partitionBy(*keys).orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = grid.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)}).filter("_t >= 5")
    f1 = f1_macro(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), F.col("N") - F.col("fp"))
    best = F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.abs(F.col("_t") - 50)).alias("near"), (-F.col("_t")).alias("small")))
    return swept.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.small") / F.lit(100.0)).alias("threshold"), F.col("b.f1").alias("macro_f1"))


def budget_threshold(scores: DataFrame, keys: list[str], budgets: list[float]) -> DataFrame:
    """Per FPR budget: among scores within the budget the highest TPR, tie to the lowest score.
    Where no score qualifies the threshold lies above the highest score (max + 1)."""
    b = scores.withColumn("budget", F.explode(F.array(*[F.lit(float(x)) for x in budgets])))
    ok = div("fp_at", "tot_neg") <= F.col("budget") + 1e-15
    out = b.groupBy(*keys, "budget").agg(
        F.max(F.when(ok, F.struct("tp_at", (-F.col("p")).alias("m"), "fp_at"))).alias("best"), F.max("p").alias("top"),
        F.max("tot_pos").alias("tot_pos"), F.max("tot_neg").alias("tot_neg"))
    zero = F.lit(0).cast("long")
    return out.select(
        *keys, "budget", F.coalesce(-F.col("best.m"), F.col("top") + 1.0).alias("threshold"),
        F.coalesce(F.col("best.tp_at"), zero).alias("tp"), F.coalesce(F.col("best.fp_at"), zero).alias("fp"),
        F.col("tot_pos").alias("n_phishing"), F.col("tot_neg").alias("n_benign"))


def adjacent_thresholds(scores: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """The chosen threshold with the next distinct score on either side, clamped at the ends.
    Two conditional extremes per group: no window over the scores."""
    j = scores.select(*keys, "p").join(F.broadcast(chosen.select(*keys, "budget", "threshold")), keys)
    return j.groupBy(*keys, "budget", "threshold").agg(
        F.coalesce(F.min(F.when(F.col("p") > F.col("threshold"), F.col("p"))), F.first("threshold")).alias("safer_neighbor"),
        F.coalesce(F.max(F.when(F.col("p") < F.col("threshold"), F.col("p"))), F.first("threshold")).alias(
            "more_permissive_neighbor"))


def order_margin(scores: DataFrame, keys: list[str], budgets: list[float]) -> DataFrame:
    """Allowed false positives per budget and the first excluded negative's score and margin."""
    b = scores.withColumn("budget", F.explode(F.array(*[F.lit(float(x)) for x in budgets])))
    allowed = F.floor(F.col("tot_neg") * F.col("budget") + 1e-12)
    # the negative of descending rank r has at most r-1 and at least r negatives at or above it
    first_out = (F.col("fp_at") >= allowed + 1) & (F.col("fp_at") - F.col("neg") < allowed + 1)
    last_in = (F.col("fp_at") >= allowed) & (F.col("fp_at") - F.col("neg") < allowed)
    return b.groupBy(*keys, "budget").agg(
        F.max(allowed).alias("allowed_fp"), F.max("tot_neg").alias("n_benign"),
        F.max(F.when(first_out, F.col("p"))).alias("first_excluded_score"),
        F.max(F.when(last_in, F.col("p"))).alias("last_allowed_score"))


def oracle_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best Macro-F1 over every distinct score and the predict-none cut, first by descending score."""
    tp, fp = F.col("tp_at"), F.col("fp_at")
    f1 = f1_macro(tp, fp, F.col("tot_pos") - tp, F.col("tot_neg") - fp)
    best = scores.groupBy(*keys).agg(
        F.max(F.struct(F.round(f1, 12).alias("f1"), F.col("p"))).alias("b"), F.max("p").alias("top"),
        F.max("tot_pos").alias("P"), F.max("tot_neg").alias("N"))
    none = F.round(f1_macro(F.lit(0), F.lit(0), F.col("P"), F.col("N")), 12)
    return best.select(*keys, F.greatest(none, F.col("b.f1")).alias("oracle_macro_f1"),
                       F.when(none >= F.col("b.f1"), F.col("top") + 1.0).otherwise(F.col("b.p")).alias("oracle_threshold"))


def calibration_bins(df: DataFrame, keys: list[str], bins: int, weight: Column | None = None, rows: str | None = None) -> DataFrame:
    """Equal-width bins, left-closed, the last one closed: n, mean score, positive rate."""
    w = weight if weight is not None else F.col(rows) if rows else F.lit(1.0)
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(
        (F.sum(rows) if rows else F.count(F.lit(1))).alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("p")).alias("sp"),
        F.sum(w * F.col("label")).alias("sy"))


def ece(df: DataFrame, keys: list[str], bins: int = 15, weight: Column | None = None, rows: str | None = None) -> DataFrame:
    b = calibration_bins(df, keys, bins, weight, rows)
    return b.groupBy(*keys).agg(div(F.sum(F.abs(F.col("sp") - F.col("sy"))), F.sum("w")).alias("ece"))


def reliability(df: DataFrame, keys: list[str], bins: int = 15, rows: str | None = None) -> DataFrame:
    """Every bin of every key, empty ones with n = 0 and NULL means."""
    b = calibration_bins(df, keys, bins, rows=rows)
    # at most ``bins`` entries per key
    m = b.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "sp", "sy")))).alias("m"))
    out = m.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cell = F.try_element_at("m", F.col("bin"))
    return out.select(*keys, "bin", F.coalesce(cell["n"], F.lit(0).cast("long")).alias("n"),
                      div(cell["sp"], cell["n"]).alias("mean_score"), div(cell["sy"], cell["n"]).alias("positive_rate"))


def entity_weights(df: DataFrame, keys: list[str], entity: str, name: str = "weight",
                   salt_by: list[str] | None = None) -> DataFrame:
    """Adds 1 / (rows of the entity in the cohort); ``keys`` must include the cohort."""
    out = with_group_stats(df, [*keys, entity], {"_size": F.count(F.lit(1))}, salt_by)
    return out.withColumn(name, 1.0 / F.col("_size")).drop("_size")


def entity_sizes(df: DataFrame, on: list[str], cell: Column, cells: int) -> DataFrame:
    """One row per entity: its rows in each of the numbered cells (run and part) as one array, and ``_n``, all its rows.
    Cells combine on the map side, so they add no rows to a shuffle."""
    per = df.withColumn("_cell", cell).groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_cell") == i).alias(f"_{i}") for i in range(cells)])
    return per.select(*on, "_n", F.array(*[F.col(f"_{i}") for i in range(cells)]).alias("_sizes"))


def weighted_ranking(scores: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """AUCs, Brier, log loss and ECE of a weighted score table: every sum over rows is a sum over its scores."""
    w, q = F.col("pos") + F.col("neg"), clipped(F.col("p"))
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    per = scores.groupBy(*keys, bin_.alias("_bin")).agg(
        auc_terms().alias("_auc"), F.max("tot_pos").alias("_P"), F.max("tot_neg").alias("_N"), pr_auc().alias("_pr"),
        F.sum(w).alias("_w"), F.sum(w * F.col("p") - F.col("pos")).alias("_gap"),
        F.sum(F.col("pos") * F.pow(F.col("p") - 1, F.lit(2)) + F.col("neg") * F.pow("p", F.lit(2))).alias("_sq"),
        F.sum(-F.col("pos") * F.ln(q) - F.col("neg") * F.ln(1 - q)).alias("_ll"))
    return per.groupBy(*keys).agg(
        div(F.sum("_auc"), F.max("_P") * F.max("_N")).alias("roc_auc"), F.sum("_pr").alias("pr_auc"), div(F.sum("_sq"), F.sum("_w")).alias("brier"),
        div(F.sum("_ll"), F.sum("_w")).alias("log_loss"), div(F.sum(F.abs(F.col("_gap"))), F.sum("_w")).alias("ece"))


def entity_confusion(df: DataFrame, keys: list[str], entity: str, threshold: Column) -> DataFrame:
    """Domain-equal confusion: per-entity mean indicators, then their sum.  No row-level join."""
    per = confusion(df, [*keys, entity], threshold)
    size = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return per.groupBy(*keys).agg(
        *[F.sum(div(c, size)).alias(c) for c in ("tp", "fp", "fn", "tn")], F.count(F.lit(1)).alias("effective_entities"))


def wilson_upper(fp: Column, n: Column, z: float = Z95) -> Column:
    p = div(fp, n)
    centre = p + z * z / (2.0 * n)
    spread = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n)
    return F.least(F.lit(1.0), (centre + spread) / (1.0 + z * z / n))
