"""C and D: normalisation steps and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import urls as U
from ..functions.columns import rnd
from .registry import query, register
from .urls_sql import FEATURE_SQL, INT_FEATURES, feature_ctes, norm_ctes

# One query per step: the columns that show the step's effect.
STEPS = {
    "c01_html_unescape": ["s_text"],
    "c02_strip_and_control": ["s_clean"],
    "c03_empty_status": ["parse_status", "normalization_changed"],
    "c04_single_slash_repair": ["s_repaired"],
    "c05_scheme_test": ["s_has_scheme", "parse_status"],
    "c06_scheme_defang": ["s_scheme"],
    "c07_host_ascii": ["host"],
    "c08_port_and_host_status": ["s_port_text", "s_raw_host", "parse_status"],
    "c09_fallback_value": ["normalized_url", "host", "parse_status"],
    "c10_default_port": ["s_kept_port"],
    "c11_ipv6_brackets": ["s_netloc"],
    "c12_userinfo": ["s_userinfo"],
    "c13_percent_upper": ["s_upper_path", "s_upper_query", "s_upper_fragment"],
    "c14_path_and_fragment": ["s_final_path", "s_final_fragment"],
    "c15_reassemble": ["normalized_url"],
    "c16_changed_flag": ["normalization_changed"],
}
# Steps past the parse are undefined on rows that did not parse.
OK_ONLY = {"c06_scheme_defang", "c10_default_port", "c11_ipv6_brackets", "c12_userinfo", "c13_percent_upper",
           "c14_path_and_fragment"}


def _step(name, cols):
    def run(spark, sf):
        out = U.normalize_steps(fx.raw_urls(spark, sf))
        if name in OK_ONLY:
            out = out.filter(F.col("parse_status") == "ok")
        return out.select("source_row", *cols)

    where = "WHERE parse_status = 'ok'" if name in OK_ONLY else ""
    register(name, run, f"SELECT source_row, {', '.join(cols)} FROM norm {where}", ("raw",), norm_ctes("fx_raw"))


for _name, _cols in STEPS.items():
    _step(_name, _cols)


@query("c17_registrable_domain", "SELECT source_row, host, registrable_domain, public_suffix FROM norm", ("raw",),
       norm_ctes("fx_raw"))
def c17(spark, sf):
    return U.attach_suffix(U.normalize_steps(fx.raw_urls(spark, sf)), fx.rules(spark)).select(
        "source_row", "host", "registrable_domain", "public_suffix")


@query("c18_distinct_then_map",
       "SELECT source_row, raw_url, normalized_url, host, registrable_domain, parse_status, normalization_changed FROM norm",
       ("urls",), norm_ctes("fx_urls"))
def c18(spark, sf):
    from ..operators.corpus import normalize_distinct

    return normalize_distinct(fx.urls(spark, sf), fx.rules(spark)).drop("dataset", "label")


def _feature(i, name):
    def run(spark, sf):
        out = U.url_features(fx.raw_urls(spark, sf), fx.rules(spark), names=[name])
        return out.select("source_row", F.col(name) if name in INT_FEATURES else rnd(name).alias(name))

    value = name if name in INT_FEATURES else f"round({name}, 9) + 0.0"
    register(f"d{i:02d}_{name}", run, f"SELECT source_row, {value} AS {name} FROM feat", ("raw",),
             feature_ctes("fx_raw", passthrough="source_row"))


for _i, _name in enumerate(FEATURE_SQL, 1):
    _feature(_i, _name)

_CANON = " || ',' || ".join(
    f"CAST({k} AS VARCHAR)" if k in INT_FEATURES else f"CAST(CAST(round({k} * 1e9) AS BIGINT) AS VARCHAR)" for k in FEATURE_SQL)
VECTOR_CTES = feature_ctes("fx_urls") + f",\nvec AS (SELECT *, sha256({_CANON}) AS feature_vector_sha256 FROM feat)"


@query("d36_feature_fingerprint",
       "SELECT source_row, dense_rank() OVER (ORDER BY feature_vector_sha256) > 0 AS has_hash, "
       "count(*) OVER (PARTITION BY feature_vector_sha256) AS same_vector_rows, feature_vector_sha256 FROM vec",
       ("urls",), VECTOR_CTES)
def d36(spark, sf):
    from ..operators.skew import with_group_stats

    out = U.url_features(fx.urls(spark, sf), fx.rules(spark)).withColumn("feature_vector_sha256", U.feature_fingerprint())
    out = out.select("source_row", "feature_vector_sha256")
    return with_group_stats(out, ["feature_vector_sha256"], {"same_vector_rows": F.count("*")}).withColumn(
        "has_hash", F.col("feature_vector_sha256").isNotNull())


@query("d37_feature_table",
       "SELECT dataset, source_row, label, 'master' AS corpus_version, sha256(raw_url) AS raw_url_sha256, "
       + ", ".join(k if k in INT_FEATURES else f"round({k}, 9) + 0.0 AS {k}" for k in FEATURE_SQL) + " FROM feat",
       ("urls",), feature_ctes("fx_urls"))
def d37(spark, sf):
    from ..operators.corpus import feature_table

    out = feature_table(fx.urls(spark, sf), fx.rules(spark), "master")
    return out.select(
        "dataset", "source_row", "label", "corpus_version", "raw_url_sha256",
        *[F.col(n) if k == "int" else rnd(n).alias(n) for n, k in U.FEATURES])


@query("d38_hash_lookup", """
SELECT 'distinct_hashes' AS metric, count(DISTINCT sha256(raw_url)) AS value FROM fx_urls
UNION ALL SELECT 'colliding_hashes', count(*) FROM (SELECT sha256(raw_url) h FROM fx_urls GROUP BY 1 HAVING count(DISTINCT raw_url) > 1)
UNION ALL SELECT 'missing_hashes', count(*) FROM (SELECT DISTINCT sha256(url || '#c') h FROM pages WHERE page_id % 20 = 1
  EXCEPT SELECT sha256(raw_url) FROM fx_urls)
""", ("urls",))
def d38(spark, sf):
    from ..operators.corpus import hash_lookup_audit

    wanted = fx.table(spark, sf, "pages").filter("page_id % 20 = 1").selectExpr(
        "sha2(cast(concat(url, '#c') as binary), 256) as raw_url_sha256")
    return hash_lookup_audit(fx.urls(spark, sf), wanted)
