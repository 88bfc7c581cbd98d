"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark import fixtures as fx  # noqa: E402
from tidemark import plans  # noqa: E402
from tidemark.functions import urls as U  # noqa: E402
from tidemark.operators import models as L  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = ["e06_corpus_audit", "h01_confusion", "h08_roc_auc", "h10_pr_auc", "h13_grid_threshold", "h14_budget_threshold",
            "h18_ece", "h21_weighted_confusion", "h29_frozen_scopes", "i02_ks", "i11_probability_shift", "i12_score_summary",
            "j05_split_summary", "j15_balanced_hash_sample", "k12_composite_score", "l02_bootstrap_ci", "l10_auc_influence",
            "l11_cluster_contributions", "o01_macro_transfer"]
URL_ROWS = 300_000
FIT_ROWS = 350_000
#: Fits over FIT_ROWS x 35: the three logistic candidates whole, the ensembles by a stated number of trees.
FITS = {"fit_lr_3_candidates": ("lr", None), "fit_rf_8_trees_of_200": ("rf", 8), "fit_boosted_10_trees_of_300": ("boosted", 10)}


def fits(spark, sf: str) -> dict[str, float]:
    """Seconds of the batched fits; the embedding rows are repeated with small deterministic shifts."""
    names = [f"f{i}" for i in range(35)]
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    copies = -(-FIT_ROWS // base.count())
    rows = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(spark.sparkContext.defaultParallelism, "copy").select(
        (F.col("vec_id") * copies + F.col("copy")).alias("sample_id"), (F.col("label") % 2).alias("label"),
        *[(F.col("embedding")[i] + F.pmod(F.xxhash64("vec_id", "copy", F.lit(i)), F.lit(1000)) / 1e4).alias(n) for i, n in enumerate(names)])
    out = {}
    for key, (family, trees) in FITS.items():
        designs = [L.Design("bench", family, c, i, {**p, **({"trees": trees} if trees else {})}, tuple(names))
                   for i, (c, p) in enumerate(L.candidate_grid(family)[:None if trees is None else 1])]
        start = time.perf_counter()
        L.fit(rows, designs, L.where(designs, lambda run: F.lit(True)))
        out[key] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in HEADLINE if not only or n in only.split(",")]
    queries, times = plans.queries(), {}
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(queries["h01_confusion"](spark, sf))  # start workers and compile the common path

    raw = fx.raw_urls(spark, sf)
    base = raw.count()
    copies = -(-URL_ROWS // base)
    many = raw.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    sink(U.url_features(raw, fx.rules(spark)))
    start = time.perf_counter()
    sink(U.url_features(many, fx.rules(spark)))
    times["url_features"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        sink(queries[name](spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
    if not only:
        times |= fits(spark, sf)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "url_rows": base * copies, "urls_per_sec": round(base * copies / times["url_features"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
