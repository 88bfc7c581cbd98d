"""URL filters by rules and link-graph propagation: personalised PageRank of trust, reversed PageRank of distrust.

A url's host and path are tested against allow and block rules (host, path prefix); the longest rule decides, and of
rules of equal length the one with the longer host, then a block rule.  Every other page takes the verdict of its
host.  Each page that an allow rule admits is a unit of trust at its host, each page that a block rule stops a unit of
distrust.  Trust walks along the links between hosts, distrust against them (who links to a blocked host loses
standing), both with restart at their seeds.  A host is blocked where its distrust is above ``ratio`` times its trust
and at least ``least`` units; hosts that neither walk reaches are allowed.

Masses are whole numbers of 1e-6 units and shares are rounded down, so every rerun, retry and engine finds the same
scores.  The mass of a host without links is not passed on.  Links are reduced to (host, host, number) before the
walks; each step is one salted join and one grouped sum over host pairs and is written to the shared folder.  Rules
are a table of any size: each host meets the rules of its own suffixes in a join, and a rule's path is compared there.

Edge cases: a null url and one without ``://`` have empty host and path, fit no rule and share one host that has no
links; null or empty html has no links; links inside a host, and relative ones, are no edges; repeated rows and null
ids are rows of their own; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LINK = r"""(?i)<a[\t\n\f\r ][^<>]*?href[\t\n\f\r ]*=[\t\n\f\r ]*["']?[\t\n\f\r ]*(?:https?:)?//([^/?#"'<>\t\n\f\r ]+)"""
UNIT = 1_000_000
STEPS = 20
RATIO = 2
LEAST = UNIT // 100


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules) -> DataFrame:
    """(host, path, rule, verdict) of rule texts such as ``example.org/es/``; a text without a slash fits every path."""
    df = spark.createDataFrame(list(rules), "rule string, verdict string") if isinstance(rules, list) else rules
    cut = F.instr("rule", "/")
    return df.select(F.translate(F.when(cut > 0, F.expr("left(rule, instr(rule, '/') - 1)")).otherwise(F.col("rule")), UPPER, LOWER).alias("rule_host"),
                     F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("path"), "rule", "verdict").distinct()


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules whose host is the host or a parent of it, the deciding one first."""
    labels = F.split("host", r"\.")
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    tails = hosts.withColumn("labels", labels).select("host", F.explode(F.expr(
        f"transform(sequence(1, least(size(labels), {deepest})), i -> array_join(slice(labels, -i, i), '.'))")).alias("rule_host"))
    order = F.struct((-F.char_length("rule")).alias("size"), (-F.char_length("rule_host")).alias("host_size"),
                     (F.col("verdict") != "block").alias("allow"), "rule", "path", "verdict")
    return tails.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("rules"))


def step(ranks: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One step of both walks.  ``edges``: (kind, host, other, share weight w, out); ``ranks``, ``seeds``: (kind, host, mass)."""
    moved = attach(edges, ranks, ["kind", "host"], ["other"]).filter("mass > 0")
    moved = moved.select("kind", F.col("other").alias("host"), (F.expr("mass * 17 div (out * 20)") * F.col("w")).alias("mass"))
    restart = seeds.select("kind", "host", F.expr("mass * 3 div 20").alias("mass"))
    return moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).filter("mass > 0")


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """(kind, host, mass) after ``steps`` steps, or before that where nothing changes any more.

    ``edges``: (src, dst, n) without loops; ``seeds``: (kind, host, mass) with kind ``trust`` or ``distrust``.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("other"), F.col("n").alias("w")).unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("other"), F.col("n").alias("w")))
    both = save(both, "op12-walks")
    both = save(attach(both, both.groupBy("kind", "host").agg(F.sum("w").alias("out")), ["kind", "host"], ["other"]), "op12-edges")

    def check(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("kind", "host", "mass"), F.lit(1 << 40)))).first()

    if both.isEmpty():
        return step(seeds, both, seeds)
    ranks, state = seeds, None
    for _ in range(steps):
        ranks = save(step(ranks, both, seeds), "op12-ranks")
        now = check(ranks)
        if now == state:
            break
        state = now
    return ranks


def judge(pages: DataFrame, rules=RULES, ratio: int = RATIO, least: int = LEAST, steps: int = STEPS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust (of the host)."""
    spark = pages.sparkSession
    found = pages.select("page_id", "url", "html").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"),
        F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)).alias("links"))
    rows = save(found, "op12-pages")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    ruled = attach(rows.drop("links"), host_rules(hosts, rule_table(spark, rules)), ["host"], ["row"])
    fit = F.filter("rules", lambda r: F.startswith(F.col("path"), r.path))
    ruled = save(ruled.withColumn("fit", F.get(fit, F.lit(0))).select(
        "page_id", "host", "path", "row", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruling")), "op12-ruled")
    edges = rows.select(F.col("host").alias("src"), F.explode("links").alias("dst")).filter("src <> dst and src <> ''").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"))
    seeds = ruled.filter("ruling is not null").groupBy(F.when(F.col("ruling") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(
        (F.count(F.lit(1)) * UNIT).alias("mass"))
    ranks = propagate(edges, save(seeds, "op12-seeds"), steps)
    scores = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"),
                                       F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"))
    out = attach(ruled, scores, ["host"], ["row"]).fillna(0, ["trust", "distrust"])
    standing = F.when((F.col("distrust") > F.col("trust") * ratio) & (F.col("distrust") >= least), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", standing).alias("verdict"), "trust", "distrust")


def _sql(steps: int = STEPS) -> str:
    """The registered query in DuckDB, the steps of both walks written out."""
    az = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    text = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {az}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, html
           FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules AS (SELECT rule, split_part(rule, '/', 1) AS rule_host, substring(rule, instr(rule, '/')) AS rule_path, verdict
          FROM (VALUES {", ".join(str(r) for r in RULES)}) t(rule, verdict)),
numbered AS (SELECT *, row_number() OVER () AS n FROM p),
ruled AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruling FROM numbered, rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
judged AS (SELECT page_id, host, path, rule, ruling FROM numbered LEFT JOIN ruled USING (n)),
edges AS (SELECT src, dst, count(*) AS n FROM (
            SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {az}) AS dst FROM p)
          WHERE src <> dst AND src <> '' GROUP BY ALL),
walks AS (SELECT 'trust' AS kind, src AS host, dst AS other, n AS w FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
outs AS (SELECT *, sum(w) OVER (PARTITION BY kind, host) AS out FROM walks),
seeds AS (SELECT CASE ruling WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) * {UNIT} AS mass
          FROM judged WHERE ruling IS NOT NULL GROUP BY ALL),
r0 AS (SELECT kind, host, mass FROM seeds)"""
    for i in range(1, steps + 1):
        text += f""",
r{i} AS MATERIALIZED (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
  SELECT kind, other AS host, ((mass * 17) // (out * 20)) * w AS mass FROM outs JOIN r{i - 1} USING (kind, host)
  UNION ALL SELECT kind, host, (mass * 3) // 20 FROM seeds) GROUP BY ALL)"""
    return text + f""",
s AS (SELECT host, sum(mass) FILTER (kind = 'trust') AS trust, sum(mass) FILTER (kind = 'distrust') AS distrust FROM r{steps} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {RATIO} AND distrust >= {LEAST}
                                                        THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN s USING (host)
"""


SQL = _sql()
