"""Queries about scores alone count samples that are alike in every run before the runs multiply them."""

import pytest
from pyspark.sql import functions as F
from test_shuffle import SF, shuffled_rows

from tidemark import fixtures as fx


def test_counts_stand_for_the_scored_rows(spark, tmp_path):
    rows = [(o, p, 7, 1, float(q), f, s) for o, p, q, f, s in [
        (1, 3, 10, "R", "O"), (8, 23, 10, "R", "O"), (8, 23, 10, "R", "O"), (2, -3, 50, "N", "F"), (9, -23, 50, "N", "F"),
        (6, 20, 1, "A", "F"), (13, 0, 1, "A", "F"), (3, 19, 50, "R", "O"), (-4, 19, 50, "R", "O"), (-11, 39, 50, "R", "O"), (None, 39, 50, "R", "O")]]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    for splits in (False, True):
        keys = ["dataset", "label", "repetition", "model", "p", *(["split"] if splits else [])]
        want = fx.scored(spark, str(tmp_path)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        got = fx.scored_counts(spark, str(tmp_path), splits).groupBy(*keys).agg(F.sum("n").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# before, the samples themselves went through a shuffle and met each run
@pytest.mark.parametrize("name", ["h09_inverted_auc", "h17_oracle_threshold", "i14_orientation_audit", "i12_score_summary"])
def test_samples_do_not_meet_the_runs(spark, name):
    assert shuffled_rows(spark, name) < spark.read.parquet(f"{SF}/lineitem.parquet").count()


# before, ten rows per sample were shuffled, twice
@pytest.mark.parametrize("name", ["e13_cohort_sets", "e14_common_cohort"])
def test_repetitions_of_a_sample_are_bits(spark, name):
    assert shuffled_rows(spark, name) < 1.2 * spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_cohort_sets_of_rare_splits(spark, tmp_path):
    """A sample that is always in the test split, a repetition that no sample of its dataset has, rows that share an id."""
    from tidemark import plans

    never = [e for e in range(40) if all((e * 31 + r * 17) % 20 >= 17 for r in range(10))]
    some = [e for e in range(20) if (e * 31) % 20 >= 17][:1]
    rows = [(i, e, 7, 1, 5.0, "R", "O") for i, e in enumerate([*never, *some, *some])] + [(50, e, 7, 1, 5.0, "N", "F") for e in (3, 3, 8)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    cohort = fx.scored(spark, str(tmp_path)).filter("split <> 'test'").select("dataset", "repetition", "sample_id").distinct().collect()
    want = []
    for d in {r.dataset for r in cohort}:
        per, size = {}, {}
        for r in cohort:
            if r.dataset == d:
                per[r.sample_id] = per.get(r.sample_id, 0) + 1
                size[r.repetition] = size.get(r.repetition, 0) + 1
        want.append((d, sum(n == 10 for n in per.values()), len(per), min(size.values()), max(size.values()), len(set(size.values()))))
    assert sorted(map(tuple, plans.queries()["e13_cohort_sets"](spark, str(tmp_path)).collect())) == sorted(want)
