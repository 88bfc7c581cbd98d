"""Rows that registered queries send through shuffles: runs of the design grid must not multiply them."""

import pytest

from tidemark import plans

SF = "/root/testdata/sf0.01"


def shuffled_rows(spark, name):
    """Rows written to shuffles by one query, from the session's own stage figures."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    plans.queries()[name](spark, SF).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


# the most rows that may be shuffled for each row of lineitem; the design grid has 20 runs
@pytest.mark.parametrize("name,most", [
    ("f01_checked_inner_join", 4),
    ("f14_alignment_check", 4),
    ("h36_replay_difference", 4),
    ("o01_macro_transfer", 3),
    ("o02_low_fpr_transfer", 3),
    ("o04_edge_budget_summary", 3),
    ("l15_transfer_gap", 3),
    ("h29_frozen_scopes", 6),
    ("h22_weighted_ranking", 5),
    ("h20_domain_weights", 3),
    ("h21_weighted_confusion", 4),
    ("g15_entity_mean", 4),
    ("r32_leakage_scope", 8),
    ("f02_left_join_null_check", 4),
    ("h31_error_disagreement", 4),
    ("j05_split_summary", 3),
    ("j18_inner_resplits", 2),
])
def test_runs_do_not_multiply_shuffles(spark, name, most):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled_rows(spark, name) <= most * rows


def test_balanced_sample_sorts_few_rows(spark):
    """The rows that meet the window are those of the blocks that the limit reaches; ties and small classes are whole."""
    from pyspark.sql import functions as F

    from tidemark.operators import splits as J

    rows = spark.range(20_000).select(F.col("id").alias("sample_id"), (F.col("id") % 50 == 0).cast("int").alias("label"), F.lit("a").alias("k"))
    rows = rows.unionByName(rows.filter("sample_id < 3").withColumn("k", F.lit(None).cast("string")))
    got = J.balanced_hash_sample(rows, ["k"], 20, "t")
    want = {}
    import hashlib

    for r in rows.collect():
        want.setdefault((r.k, r.label), []).append((hashlib.sha256(f"t:{r.sample_id}".encode()).hexdigest(), r.sample_id))
    want = {(k, y, i) for (k, y), v in want.items() for _, i in sorted(v)[:10]}
    assert {(r.k, r.label, r.sample_id) for r in got.collect()} == want
    assert "_last" in got._jdf.queryExecution().optimizedPlan().toString()


# repetitions multiply entities, not rows: ten repetitions of the rows would exceed every figure
@pytest.mark.parametrize("name,most", [("j02_group_disjoint_split", 4), ("r15_third_source_splits", 4), ("j12_cross_source_roles", 6), ("j13_overlap_before_after", 8)])
def test_repetitions_do_not_multiply_rows_of_splits(spark, name, most):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled_rows(spark, name) <= most * rows
