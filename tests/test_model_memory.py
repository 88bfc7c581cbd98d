"""What a task holds while trees grow and while rows are scored."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import models as L
from tidemark.operators import trees as T


def test_large_models_meet_the_rows_in_passes(spark, monkeypatch):
    """Before, a task held all trees of a model at once."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(i, int(v[0] * v[1] > 0), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, label int, a double, b double, c double").cache()
    designs = [L.Design("r", "rf", "f", 0, {"trees": 9, "depth": 6, "leaf": 1, "balanced": False}, ("a", "b", "c")),
               L.Design("r", "boosted", "b", 0, {"trees": 30, "depth": 3, "rate": 0.1, "balanced": False}, ("a", "b", "c"))]
    models = L.fit(df, designs, L.where(designs, lambda r: F.col("sample_id") < 250))
    size = {r.model: r.bytes for r in spark.read.parquet(models[0].stored).groupBy("model").agg(F.sum(F.length("data")).alias("bytes")).collect()}
    assert [m.bytes for m in models] == [size[0], size[1]]
    monkeypatch.setattr(L, "TREE_BYTES", size[0] // 4)
    scored = L.score(df, models, None, ["sample_id"])
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") > 3
    got = {(r.sample_id, r.model): r.p for r in scored.collect()}
    for d, m in enumerate(models):
        assert [got[i, d] for i in range(300)] == list(m.probabilities(x, ["a", "b", "c"]))


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_growing_trees_hold_a_byte_per_value():
    rng = np.random.default_rng(6)
    rows, columns = 200_000, tuple(range(30))
    bins = rng.integers(0, 256, (rows, len(columns))).astype(np.uint8)
    y, bag = (rng.random(rows) < 0.5).astype(float), np.ones(rows)
    boosted = T.Rule(True, 1, 3, 1, 0.1, 9, columns, (1.0, 1.0), 0.0)
    assert peak(lambda: T.grow(boosted, 0, bins, y, bag, np.zeros(rows))) < 7 * rows * len(columns)
    # cells of a forest's level: sums of a step, not of all nodes
    forest = T.Rule(False, 1, 11, 1, 1.0, 9, columns, (1.0, 1.0), 0.0)
    assert peak(lambda: T.grow(forest, 0, bins, y, bag, None)) < 100 << 20


def test_corpora_of_a_study_need_not_fit_one_broadcast(spark, monkeypatch):
    """Designs on rows of their own are grown in turn inside tasks; before, all levels of all designs became jobs."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 3))
    rows = [(i, int(v[0] * v[1] > 0), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, label int, a double, b double, c double").cache()
    params = {"rf": {"trees": 3, "depth": 5, "leaf": 1, "balanced": False}, "boosted": {"trees": 4, "depth": 2, "rate": 0.1, "balanced": True}}
    designs = [L.Design(run, f, f, 0, p, ("a", "b", "c")) for run in ("u", "v", "w") for f, p in params.items()]
    parts = {"u": F.col("sample_id") < 200, "v": F.col("sample_id").between(200, 399), "w": F.col("sample_id") >= 400}
    fits = L.where(designs, parts.get)
    whole = L.fit(df, designs, fits)
    calls = []
    spark_fit = T._spark_fit
    monkeypatch.setattr(T, "_spark_fit", lambda rows, rules: calls.append(len(rules)) or spark_fit(rows, rules))
    apart = L.fit(df, designs, fits, local_bytes=200 * 32 + 1000)  # u, v fit one at a time, w does not
    assert calls == [2] and len({m.stored for m in apart}) == 3
    for a, b in zip(whole, apart):
        assert len(a.trees) == len(b.trees) == a.size == b.size
        for s, t in zip(a.trees, b.trees):
            assert np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.allclose(s.value, t.value, atol=1e-9)
    p, q = ({(r.sample_id, r.model): r.p for r in L.score(df, m, fits, ["sample_id"]).collect()} for m in (whole, apart))
    assert len(p) == 2 * 900 and p.keys() == q.keys() and all(abs(p[k] - q[k]) < 1e-9 for k in p)
