"""Corpus identity, duplicates, conflicts and cleaning (A, B, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.columns import sha256, sorted_text
from .skew import skew_join, with_group_stats


def normalize_distinct(df: DataFrame, rules: U.SuffixRules, raw: str = "raw_url") -> DataFrame:
    """Normalise each distinct raw URL once and map the result back to every row."""
    distinct = df.groupBy(raw).agg(F.count(F.lit(1)).alias("_n"))
    done = U.normalize_urls(distinct, rules, raw)
    return skew_join(df, done, [raw], "_n").drop("_n")


def normalized_corpus(df: DataFrame, rules: U.SuffixRules) -> DataFrame:
    """Raw rows plus hashes and the normaliser's columns."""
    out = U.normalize_urls(df, rules)
    return out.withColumns({
        "label_name": F.when(F.col("label") == 1, "phishing").otherwise("benign"),
        "raw_url_sha256": sha256("raw_url"),
        "normalized_url_sha256": sha256("normalized_url"),
    })


def feature_table(df: DataFrame, rules: U.SuffixRules, version: str) -> DataFrame:
    out = U.url_features(df, rules)
    return out.withColumns({
        "corpus_version": F.lit(version),
        "raw_url_sha256": sha256("raw_url"),
        "feature_vector_sha256": U.feature_fingerprint(),
    }).drop("raw_url")


def hash_lookup_audit(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts of distinct hashes, hashes with two raw values, and wanted hashes that are absent."""
    lookup = df.groupBy(sha256("raw_url").alias("raw_url_sha256")).agg(
        F.min("raw_url").alias("lo"), F.max("raw_url").alias("hi"))
    counts = lookup.agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("lo") != F.col("hi")).alias("c"))
    missing = wanted.distinct().join(lookup, "raw_url_sha256", "left_anti").agg(F.count(F.lit(1)).alias("m"))
    rows = counts.selectExpr("stack(2, 'distinct_hashes', d, 'colliding_hashes', c) as (metric, value)")
    return rows.unionByName(missing.selectExpr("'missing_hashes' as metric", "m as value"))


def duplicate_groups(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Groups of more than one row per (dataset, key) with their labels."""
    return (
        df.groupBy("dataset", F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("label").alias("distinct_labels"),
             sorted_text("label").alias("labels"))
        .filter("row_count > 1")
        .withColumn("duplicate_type", F.lit(kind))
    )


def conflict_flag(df: DataFrame, key: str = "normalized_url_sha256") -> DataFrame:
    """Adds ``conflict``: the (dataset, key) group carries more than one label."""
    out = with_group_stats(df, ["dataset", key], {"_lo": F.min("label"), "_hi": F.max("label")})
    return out.withColumn("conflict", F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


def remove_conflicts(df: DataFrame, key: str = "normalized_url_sha256") -> DataFrame:
    return conflict_flag(df, key).filter(~F.col("conflict")).drop("conflict")


def master_corpus(norm: DataFrame) -> DataFrame:
    """Parsed rows whose normalised URL has one label; same-label duplicates stay."""
    return remove_conflicts(norm.filter("parse_status = 'ok'"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order.  ``min`` of a struct combines on the map side, so a
    heavily repeated key never gathers in one task (a row_number window would)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def deduplicated_corpus(norm: DataFrame) -> DataFrame:
    return first_per_key(master_corpus(norm), ["dataset", "normalized_url_sha256"], ["source_row"])


def duplicate_flag(df: DataFrame, keys: list[str], order: str = "source_row") -> DataFrame:
    """True for every row of a key but the first in order (``order`` unique within a key)."""
    out = with_group_stats(df, keys, {"_first": F.min(order)})
    return out.withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first")


def corpus_audit(norm: DataFrame) -> DataFrame:
    """(dataset, metric, value): one pass of per-row counts and one of per-key counts."""
    rows = norm.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 0).alias("benign_rows"),
        F.count_if(F.col("label") == 1).alias("phishing_rows"),
        F.count_if(F.col("parse_status") == "ok").alias("parsed_rows"),
        F.count_if(F.col("parse_status") != "ok").alias("rejected_rows"),
        F.count_if(F.col("parse_status") == "empty").alias("empty_rows"),
        F.count_if(F.col("normalization_changed")).alias("changed_rows"),
    )
    keys = _key_counts(norm, "raw_url_sha256", "raw").join(
        _key_counts(norm.filter("parse_status = 'ok'"), "normalized_url_sha256", "normalized"), "dataset")
    hosts = norm.filter("parse_status = 'ok'").groupBy("dataset", "host", "registrable_domain").agg(
        F.lit(1).alias("one")).groupBy("dataset").agg(
        F.count_distinct("host").alias("distinct_hosts"),
        F.count_distinct("registrable_domain").alias("distinct_domains"))
    wide = rows.join(keys, "dataset").join(hosts, "dataset")
    metrics = [c for c in wide.columns if c != "dataset"]
    return wide.select("dataset", *[F.col(m).cast("long").alias(m) for m in metrics]).unpivot(
        ["dataset"], metrics, "metric", "value")


def _key_counts(df: DataFrame, key: str, tag: str) -> DataFrame:
    groups = df.groupBy("dataset", key).agg(
        F.count(F.lit(1)).alias("n"), (F.min("label") != F.max("label")).alias("mixed"))
    return groups.groupBy("dataset").agg(
        F.count(F.lit(1)).alias(f"distinct_{tag}"),
        (F.sum("n") - F.count(F.lit(1))).alias(f"extra_{tag}_rows"),
        F.count_if(F.col("mixed")).alias(f"conflicting_{tag}_groups"),
        F.coalesce(F.sum(F.when(F.col("mixed"), F.col("n"))), F.lit(0)).alias(f"conflicting_{tag}_rows"),
    )


def cross_dataset_overlap(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Keys (empty ones aside) seen in more than one dataset."""
    return (
        df.filter(F.col(key) != "").groupBy(F.col(key).alias("key"))
        .agg(F.count_distinct("dataset").alias("dataset_count"), F.count(F.lit(1)).alias("row_count"),
             sorted_text("dataset").alias("datasets"))
        .filter("dataset_count > 1").withColumn("key_type", F.lit(kind))
    )


def vector_duplicate_audit(features: DataFrame) -> DataFrame:
    """Per dataset: groups of equal feature vectors, extra rows, label conflicts, URLs per vector."""
    per_url = features.groupBy("dataset", "feature_vector_sha256", "raw_url_sha256").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n0"),
        F.count_if(F.col("label") == 1).alias("n1"))
    groups = per_url.groupBy("dataset", "feature_vector_sha256").agg(
        F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("urls"))
    dup, conflict = F.col("n") > 1, (F.col("n0") > 0) & (F.col("n1") > 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return groups.groupBy("dataset").agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_vectors"),
        F.count_if(dup).alias("duplicate_groups"),
        zero(F.sum(F.when(dup, F.col("n") - 1))).alias("extra_rows"),
        F.count_if(conflict).alias("conflicting_groups"),
        zero(F.sum(F.when(conflict, F.col("n")))).alias("conflicting_rows"),
        zero(F.sum(F.when(conflict, F.col("n0")))).alias("conflicting_benign"),
        zero(F.sum(F.when(conflict, F.col("n1")))).alias("conflicting_phishing"),
        F.max("urls").alias("max_urls_per_vector"),
    )


def cleaning_funnel(norm: DataFrame, excluded_domains: DataFrame) -> DataFrame:
    """(dataset, stage, label, rows) from raw to domain-filtered; each row counts once per stage it reaches."""
    flagged = conflict_flag(norm.filter("parse_status = 'ok'"))
    dedup = first_per_key(flagged.filter("not conflict"), ["dataset", "normalized_url_sha256"], ["source_row"])
    kept = skew_flag(dedup, excluded_domains, ["registrable_domain"], "_excluded")
    parts = [
        norm.select("dataset", "label", F.lit("1_raw").alias("stage")),
        flagged.select("dataset", "label", F.explode(F.expr(
            "if(conflict, array('2_valid'), array('2_valid', '3_conflict_free'))")).alias("stage")),
        kept.select("dataset", "label", F.explode(F.expr(
            "if(_excluded, array('4_deduplicated'), array('4_deduplicated', '5_domain_filtered'))")).alias("stage")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("dataset", "stage", "label").agg(F.count(F.lit(1)).alias("row_count"))


def skew_flag(df: DataFrame, keys_df: DataFrame, on: list[str], name: str,
              salt_by: list[str] | None = None) -> DataFrame:
    """Existence flag: does the row's key occur in ``keys_df``?  Weighted by the rows of ``df``."""
    present = keys_df.select(*on).distinct().withColumn("_p", F.lit(True))
    stats = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(present, on, "left").filter("_p")
    return skew_join(df, stats, on, "_n", salt_by=salt_by).withColumn(name, F.coalesce(F.col("_p"), F.lit(False))).drop("_p", "_n")
