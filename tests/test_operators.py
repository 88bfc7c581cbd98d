"""Unit rows, brute-force comparisons and plan checks on small frames."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions import urls as U
from tidemark.functions.special import clopper_pearson_upper, t_upper_tail, wilcoxon_p
from tidemark.operators import contracts as C
from tidemark.operators import cumulative as Q
from tidemark.operators import inference as I
from tidemark.operators import metrics as M
from tidemark.operators import splits as J
from tidemark.operators.skew import skew_join, with_group_stats
from tidemark.sources import files as S

SF = "/root/testdata/sf0.001"


def one(spark, url, keep=False):
    df = spark.createDataFrame([(url,)], "raw_url string")
    return U.normalize_urls(df, fx.rules(spark), keep_fragment=keep).first()


@pytest.mark.parametrize("url,expected", [
    ("\tHTTP://Shop.Mein-Laden.CO.UK:80/w/v/k?a=7&b=#top", ("http://shop.mein-laden.co.uk/w/v/k?a=7&b=", "shop.mein-laden.co.uk", "mein-laden.co.uk", "ok")),
    ("host.com:8080/p", ("host.com:8080/p", "", "", "unparsed_host")),
    ("http:/x.com", ("http://x.com/", "x.com", "x.com", "ok")),
    ("http://h:99999/", ("http://h:99999/", "", "", "invalid_port")),
    ("http://bücher.de/ä?q=%c3", ("http://xn--bcher-kva.de/ä?q=%C3", "xn--bcher-kva.de", "xn--bcher-kva.de", "ok")),
    ("hxxps://a.ck/&eacute;", ("https://a.ck/é", "a.ck", "a.ck", "ok")),
    ("http://www.ck/x", ("http://www.ck/x", "www.ck", "www.ck", "ok")),
    ("http://u:p@[2001:db8::1]:8080", ("http://u:p@[2001:db8::1]:8080/", "2001:db8::1", "2001", "ok")),
    ("", ("", "", "", "empty")),
    (None, ("", "", "", "empty")),
])
def test_normalizer_vectors(spark, url, expected):
    r = one(spark, url)
    assert (r.normalized_url, r.host, r.registrable_domain, r.parse_status) == expected


def test_feature_vector(spark):
    df = spark.createDataFrame([("\tHTTP://Shop.Mein-Laden.CO.UK:80/w/v/k?a=7&b=#top",)], "raw_url string")
    r = U.url_features(df, fx.rules(spark)).first()
    assert (r.has_port, r.path_segment_count, r.query_parameter_count, r.subdomain_depth, r.fragment_length) == (0, 3, 2, 1, 3)
    text = "http://shop.mein-laden.co.uk/w/v/k?a=7&b=#top"
    n = len(text)
    entropy = -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text))
    assert r.url_length == n and abs(r.url_char_entropy - entropy) < 1e-12


def scored(spark, rows):
    return spark.createDataFrame([("k", int(y), float(p)) for y, p in rows], "k string, label int, p double")


def test_budget_threshold_vector(spark):
    df = scored(spark, [(0, .05), (1, .35), (0, .15), (1, .5), (0, .4), (1, .65), (0, .55), (1, .95)])
    r = {x.budget: (x.threshold, x.tp, x.fp) for x in M.budget_threshold(M.score_table(df, ["k"]), ["k"], [0.0, 0.25]).collect()}
    assert r == {0.0: (0.65, 2, 0), 0.25: (0.5, 3, 1)}


def test_ece_perfect(spark):
    assert M.ece(scored(spark, [(0, 0), (0, 0), (1, 1), (1, 1)]), ["k"]).first().ece == 0.0


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def test_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", "cold"), "label": rng.integers(0, 2, n), "p": np.round(rng.random(n) ** 3, 3)})
    df = spark.createDataFrame(pdf)
    got = {}
    for rows in (None, 10**9, 200, 3):
        s = M.score_table(df, ["k"], block_rows=rows)
        got[rows] = {r.k: r.a for r in s.groupBy("k").agg(M.roc_auc().alias("a")).collect()}
        q = {r.k: r for r in Q.quantiles(df, ["k"], "p", {"q": 0.37}, block_rows=rows).collect()}
        for k in ("hot", "cold"):
            part = pdf[pdf.k == k]
            assert abs(got[rows][k] - brute_auc(part.label.to_numpy(), part.p.to_numpy())) < 1e-12
            assert abs(q[k].q - np.quantile(part.p, 0.37)) < 1e-12
    assert got[None] == got[10**9] == got[200] == got[3]


def test_radix_blocks_follow_the_order_of_values(spark):
    """Special values, neighbours of powers of two, both signs, and a crowd within 1e-9: coarse and fine blocks never run
    against the order, and running sums in refined blocks equal a plain window."""
    rng = np.random.default_rng(8)
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, float("inf"), float("-inf"), float("nan"), None]
    for e in range(-60, 61):
        p = 2.0 ** e
        values += [p, np.nextafter(p, 0), np.nextafter(p, 2 * p), -p, -np.nextafter(p, 0)]
    values += [*rng.normal(size=500), *(0.7 + rng.random(500) * 1e-9), *rng.integers(-50, 50, 100).astype(float)]
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double").distinct()
    rows = df.select("v", Q.radix("v", Q.COARSE).alias("c"), Q.radix("v", Q.FINE).alias("f")).orderBy("v").collect()
    assert all(a.c <= b.c and a.f <= b.f and a.c << 16 <= b.f if a.c < b.c else a.f <= b.f for a, b in zip(rows, rows[1:]))
    counts = df.filter("v is not null and not isnan(v)").select(F.lit("k").alias("k"), "v", F.lit(1).cast("long").alias("n"))
    plain, cut = ({r.v: (r.cum_n, r.tot_n, r.nxt) for r in Q.running_sums(counts, ["k"], "v", ["n"], b, "nxt").collect()} for b in (None, 20))
    assert plain == cut and len(plain) > 1000


def test_spearman_paths_agree(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, 2000)
    pdf = pd.DataFrame({"k": np.where(np.arange(2000) % 3 == 0, "a", "b"), "x": x.astype(float), "y": (x + rng.integers(0, 25, 2000)).astype(float)})
    df = spark.createDataFrame(pdf)
    small = {r.k: r.rho for r in Q.spearman(df, ["k"], "x", "y").collect()}
    large = {r.k: r.rho for r in Q.spearman(df, ["k"], "x", "y", block_rows=150).collect()}
    for k, g in pdf.groupby("k"):
        want = np.corrcoef(g.x.rank(), g.y.rank())[0, 1]
        assert abs(small[k] - want) < 1e-10 and abs(large[k] - want) < 1e-10
    constant = Q.spearman(df.withColumn("y", F.lit(1.0)), ["k"], "x", "y", constant=0.0).collect()
    assert {r.rho for r in constant} == {0.0}


def test_skew_join_equals_plain_join(spark):
    rows = [(i, "hot" if i % 3 else f"e{i % 50}") for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, g string")
    got = {(r.id, r.n) for r in with_group_stats(df, ["g"], {"n": F.count(F.lit(1))}).collect()}
    counts = pd.DataFrame(rows, columns=["id", "g"]).groupby("g", dropna=False).size()
    counts.index = [None if isinstance(k, float) else k for k in counts.index]
    assert got == {(i, int(counts[g])) for i, g in rows}
    # keys past the broadcast limit take the shuffle side
    side = df.groupBy("g").agg(F.count(F.lit(1)).alias("w"))
    import tidemark.operators.skew as sk

    old, sk.HOT_GROUPS = sk.HOT_GROUPS, 1
    try:
        assert {(r.id, r.w) for r in skew_join(df, side, ["g"], "w").collect()} == got
    finally:
        sk.HOT_GROUPS = old


def test_grouped_split_invariants(spark):
    rng = np.random.default_rng(1)
    ent = np.concatenate([np.zeros(1500, int), rng.integers(1, 400, 4500)])  # one entity holds a quarter of the rows
    pdf = pd.DataFrame({"id": range(6000), "run": 0, "entity": ent, "label": (rng.random(6000) < 0.3).astype(int)})
    df = spark.createDataFrame(pdf)
    out = J.grouped_split(df, ["run"], "entity", F.lit("s")).toPandas()
    assert len(out) == 6000 and out.groupby("entity").split.nunique().max() == 1
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.15) < 0.03
    # the block size never changes a result
    want = dict(zip(out.id, out.split))
    for prefix in (0, 1):
        other = J.grouped_split(df, ["run"], "entity", F.lit("s"), prefix=prefix).toPandas()
        assert dict(zip(other.id, other.split)) == want


def test_holdout_without_valid_draw_fails(spark):
    rows = [("ok", f"e{i}", i % 2) for i in range(40)] + [("bad", f"e{i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "run string, entity string, label int")
    assert J.group_holdout(df.filter("run = 'ok'"), ["run"], "entity", "h", 0.5).count() == 40
    with pytest.raises(Exception, match="both classes on both sides"):
        J.group_holdout(df, ["run"], "entity", "h", 0.5).collect()


def test_manifests_keep_folders_apart(spark, tmp_path):
    tmp_path = tmp_path / "r t"
    tmp_path.mkdir()
    want = {}
    for folder, text in (("a b", "one\r\ntwo"), ("c", "three\r")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.txt").write_bytes(text.encode())
        want[f"{folder}/part.txt"] = (len(text), hashlib.sha256(text.encode()).hexdigest())
    got = {r.path.replace("%20", " "): (r.bytes, r.sha256) for r in S.manifest(spark, str(tmp_path), "*.txt").collect()}
    assert got == want
    other = S.manifest(spark, str(tmp_path), "*.txt").withColumn("bytes", F.col("bytes") + F.endswith("path", F.lit("c/part.txt")).cast("int"))
    assert [(r.path, r.reason) for r in S.manifest_mismatches(S.manifest(spark, str(tmp_path), "*.txt"), other).collect()] == [("c/part.txt", "bytes")]
    (line,) = S.canonical_text_hash(spark, str(tmp_path / "c")).collect()
    assert (line.path, line.sha256) == ("part.txt", hashlib.sha256(b"three\n").hexdigest())


def test_holdout_takes_the_first_valid_draw(spark):
    """Small runs against plain Python; some need draws of the second word of bits."""
    def held(attempt, entity):
        return int(hashlib.sha256(f"h:{attempt}:{entity}".encode()).hexdigest()[:8], 16) / 2 ** 32 < 0.5

    runs = {f"r{k}": [(f"{k}e{i}", label) for i in range(2) for label in (0, 1)] for k in range(60)}
    runs |= {f"q{k}": [(f"{k}f{i}", i % 2) for i in range(4)] for k in range(60)}
    late = next(k for k in range(10 ** 7) if all(held(a, f"l{k}") == held(a, f"m{k}") for a in range(12)))
    runs["late"] = [(f"{side}{late}", label) for side in "lm" for label in (0, 1)]

    def first(rows):
        return next(a for a in range(100) if {(held(a, e), y) for e, y in rows} == {(h, y) for h in (True, False) for y in (0, 1)})

    df = spark.createDataFrame([(r, e, y) for r, rows in runs.items() for e, y in rows], "run string, entity string, label int")
    want = {r: first(rows) for r, rows in runs.items()}
    for word in (50, 7):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(J, "WORD", word)
            out = J.group_holdout(df, ["run"], "entity", "h", 0.5).collect()
        assert {r.run: r.attempt for r in out} == want and max(want.values()) >= 12
        assert all(r.held == held(r.attempt, r.entity) for r in out)


def test_reversed_scores_have_their_own_pass(spark):
    # 1 - p merges scores that p and -p keep apart
    df = scored(spark, [(1, .3), (0, .3 + 6e-17), (1, 1e-17), (0, 2e-17)])
    r = M.reversal_errors(df, ["k"]).first()
    assert (r.roc_auc, r.inverted_auc, r.negated_auc) == (0.25, 0.5, 0.75)
    assert (r.complement_error, r.negation_error) == (0.25, 0.0)


def test_special_functions(spark):
    df = spark.createDataFrame([(0, 10, 2.0, 9.0), (3, 100, -1.0, 9.0)], "fp int, n int, t double, df double")
    r = df.select(clopper_pearson_upper("fp", "n").alias("u"), t_upper_tail("t", "df").alias("p")).collect()
    assert abs(r[0].u - (1 - 0.05 ** 0.1)) < 1e-10
    assert abs(r[0].p - 0.038276) < 1e-5 and abs(r[1].p - 0.828282) < 1e-3
    w = spark.createDataFrame([(55.0, 10, 0.0), (27.5, 10, 0.0)], "w double, n int, t double").select(wilcoxon_p("w", "n", "t").alias("p")).collect()
    assert abs(w[0].p - 2 / 1024) < 1e-12 and w[1].p == 1.0


def test_influence_sums_to_zero(spark):
    i = I.auc_influence(fx.scored(spark, SF).filter("repetition < 2"), ["dataset", "repetition", "model"])
    s = i.groupBy("dataset", "repetition", "model").agg(F.sum("influence").alias("s")).collect()
    assert max(abs(r.s) for r in s) < 1e-9


def test_checked_join_rejects(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    dup = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, b string")
    with pytest.raises(Exception, match="duplicate key"):
        C.checked_join(a, dup, ["k"]).collect()
    with pytest.raises(Exception, match="unmatched key"):
        C.checked_join(a, dup.filter("k = 2"), ["k"], cover="both").collect()
    assert C.checked_join(a, dup.filter("b <> 'q'"), ["k"], cover="both").count() == 2
    # a pruned payload does not prune the check
    joined = C.checked_join(a, dup, ["k"])
    for run in (joined.count, joined.select("k").collect, joined.groupBy("k").count().collect):
        with pytest.raises(Exception, match="duplicate key"):
            run()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from tidemark import plans

    p = plan_of(plans.queries()["a05_filtered_scan"](spark, SF))
    assert "PushedFilters: [" in p and "GreaterThanOrEqual(l_qu" in p.split("PushedFilters")[1]
    p = plan_of(plans.queries()["h01_confusion"](spark, SF))
    assert "l_extendedprice" not in p and "l_shipdate" not in p


def test_normalizer_needs_no_shuffle(spark):
    p = plan_of(U.url_features(fx.raw_urls(spark, SF), fx.rules(spark), names=["url_length", "subdomain_depth"]))
    assert "hashpartitioning" not in p and "SortMergeJoin" not in p and p.count("BroadcastHashJoin") == len(fx.rules(spark).depths)


def test_suffix_rules_from_file(spark, tmp_path):
    from tidemark.sources.suffixes import read_suffix_rules

    (tmp_path / "rules.dat").write_text("// c\ncom\n*.ck\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\nblog.com\n")
    rules = read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    df = spark.createDataFrame([("http://a.b.blog.com/",), ("http://x.foo.ck/",), ("http://www.ck/",)], "raw_url string")
    got = [r.registrable_domain for r in U.normalize_urls(df, rules).collect()]
    assert got == ["blog.com", "x.foo.ck", "www.ck"]


def test_suffix_rules_of_any_depth(spark):
    rules = U.suffix_rules(spark, ["org", "ck", "*.ck", "!www.ck", "f.e.d.c.b.org", "*.d.c.b.org", "!x.d.c.b.org", "1.2.3.4.5.6.7.8.9.org"])
    assert rules.depths == (1, 2, 4, 5, 6, 10) and rules.small
    want = {"a.z.f.e.d.c.b.org": "z.f.e.d.c.b.org", "f.e.d.c.b.org": "f.e.d.c.b.org", "q.y.d.c.b.org": "q.y.d.c.b.org", "q.x.d.c.b.org": "x.d.c.b.org",
            "d.c.b.org": "b.org", "k.j.1.2.3.4.5.6.7.8.9.org": "j.1.2.3.4.5.6.7.8.9.org", "ck": "ck", "b.ck": "b.ck", "a.b.ck": "a.b.ck", "www.ck": "www.ck", "no.rule": "no.rule"}
    df = spark.createDataFrame([(f"http://{h}/", h) for h in want], "raw_url string, h string")
    for given in (rules, U.parse_suffix_rules(spark.createDataFrame([(r,) for r in ["org", "ck", "*.ck", "!www.ck", "f.e.d.c.b.org", "*.d.c.b.org", "!x.d.c.b.org",
                                                                                    "1.2.3.4.5.6.7.8.9.org"]], "rule string"))):
        assert given.depths == rules.depths
        assert {r.h: r.registrable_domain for r in U.normalize_urls(df, given).collect()} == want
    bare = U.normalize_urls(df, U.suffix_rules(spark, [])).filter("h = 'b.ck'").first()
    assert bare.registrable_domain == "b.ck"


def test_correlation_of_a_constant_is_nan(spark):
    """Rankings that agree in every fold leave one side constant; the other groups keep their figure."""
    from tidemark.functions.columns import correlation

    rows = [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("v", 1.0, 2.0), ("v", 2.0, 4.0), ("v", None, 9.0), ("e", None, 1.0)]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(correlation("x", "y").alias("c")).collect()}
    assert got["c"] != got["c"] and abs(got["v"] - 1.0) < 1e-12 and got["e"] is None


def test_totals_of_placed_entities_are_those_of_the_placement(spark):
    """Blocks that no cut goes through count as sums; large entities, one-class strata and few entities included."""
    df = spark.range(6000).select(
        F.when(F.col("id") < 900, F.lit(7)).otherwise(F.col("id") % 700).alias("entity"), (F.xxhash64("id") % 3 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k")).unionByName(
        spark.createDataFrame([(1, 1, 5), (2, 0, 5), (3, 0, 6)], "entity long, label int, k long"))
    counts = J.class_counts(df, ["k"], "entity")
    placed = J.assign_entities(counts.filter("k is not null"), ["k"], "entity", J.SHARES, F.lit("s"))
    want = {(r.k, r.part): (r.a, r.b) for r in placed.groupBy("k", "part").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).collect()}
    for prefix in (0, 1, 3):
        got = J.placed_totals(counts, ["k"], "entity", J.SHARES, F.lit("s"), prefix)
        assert {(r.k, r.part): (r.n0, r.n1) for r in got.collect() if r.k is not None} == want
    sizes = J.stratified_sizes(df.filter("k is not null").groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")), ["k"])
    rows = J.row_stratified(df.filter("k is not null").withColumn("id", F.monotonically_increasing_id()), ["k"], "id", F.lit("s"))
    assert {(r.k, r.label, r.split, r.n) for r in sizes.collect()} == {
        (r.k, r.label, r.split, r["count"]) for r in rows.groupBy("k", "label", "split").count().collect()}


def test_split_summary_of_runs_is_that_of_their_rows(spark):
    """Rows with their splits as bits, against one row per repetition; nulls, ties and entities in several splits included."""
    rows = [("a" if i % 5 else "b", None if i % 17 == 0 else i % 23, i % 7, [0, 1, None][i % 3] if i % 9 == 0 else i % 2,
             [(i * 31 + r * 5 + i // 7) % 3 for r in range(4)]) for i in range(400)]
    schema = "k string, e int, h int, label int, parts array<int>"
    df = spark.createDataFrame(rows, schema)
    bits = df.withColumn("splits", F.aggregate(F.transform("parts", lambda p, i: F.pow(F.lit(2.0), 3 * i + p).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))
    long = df.select("k", "e", "h", "label", F.posexplode("parts").alias("repetition", "part")).withColumn(
        "split", F.element_at(F.array(*[F.lit(s) for s in J.SPLITS]), F.col("part") + 1))
    want = J.split_summary(long, ["k", "repetition"], ["e", "h"])
    got = J.split_summary(bits, ["k"], ["e", "h"], runs=4)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 24


def test_counted_entities_take_the_splits_of_their_rows(spark):
    """Placement without sorting every entity: by hand, at every block size, with large entities and a null key."""
    rows = [("a" if i % 3 else "b" if i % 2 else None, 7 if i < 90 else i % 61, int(i % 5 == 0 or i % 61 < 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, e int, label int")
    counts = {}
    for k, e, y in rows:
        counts.setdefault(k, {}).setdefault(e, [0, 0])[y] += 1
    want = {}
    for k, of in counts.items():
        for kind in range(3):
            mine = {e: sum(n) for e, n in of.items() if (0 if not n[1] else 1 if not n[0] else 2) == kind}
            total, upto = sum(mine.values()), 0
            order = sorted(mine, key=lambda e: (-mine[e] if mine[e] * J.LARGE > total else 0, hashlib.sha256(f"s:{e}".encode()).hexdigest()))
            for e in order:
                middle = (2 * upto + mine[e]) * J.UNITS
                want[k, e] = None if k is None else J.SPLITS[sum(middle >= 2 * c * total for c in (7000, 8500))]
                upto += mine[e]
    for prefix in (0, 1, 3):
        out = J.grouped_split(J.class_counts(df, ["k"], "e", rows=F.count(F.lit(1))), ["k"], "e", F.lit("s"), prefix=prefix, counted=True)
        assert {(r.k, r.e): r.split for r in out.collect()} == want
        assert out.agg(F.sum("rows")).first()[0] == 900
    assert {(r.k, r.e): r.split for r in J.grouped_split(df, ["k"], "e", F.lit("s")).collect()} == want
