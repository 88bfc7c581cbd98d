"""Batched logistic fits and histogram trees: optimality, independence of the batch, both ways of growing, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as L
from tidemark.operators import trees as T
from tidemark.operators.logit import fit_logistic

NAMES = ["a", "b", "c", "d", "e", "f"]


def data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 10, 0.1, 1, 1, 1] + [0, 50, 0, 0, 0, 0]
    x[:, 3] = np.round(x[:, 3])
    x[:, 5] = 2.5  # constant
    y = (x[:, 0] + 0.2 * (x[:, 1] - 50) * x[:, 3] + rng.normal(size=n) > 0.4).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = data()
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "sample_id long, label int, " + ", ".join(f"{n} double" for n in NAMES)).repartition(5).cache()


def gradient(model, x, y, columns, c, weights):
    """Gradient of the objective in standardised units at a fitted model."""
    mean, sd = x[:, columns].mean(0), x[:, columns].std(0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    z = np.column_stack([np.ones(len(x)), (x[:, columns] - mean) / sd])
    beta = np.array(model.coefficients) * sd
    at = np.concatenate([[model.intercept + (np.array(model.coefficients) * mean).sum()], beta])
    w = np.where(y == 1, weights[1], weights[0])
    g = c * z.T @ (w * (1 / (1 + np.exp(-z @ at)) - y))
    g[1:] += beta
    return np.abs(g).max()


def test_logistic_fits_are_stationary_and_independent_of_their_batch(frame):
    x, y = data()
    designs = [{"features": ["a", "b", "d"], "C": 0.1, "balanced": False}, {"features": NAMES, "C": 1.0, "balanced": True},
               {"features": ["c"], "C": 100.0, "balanced": False}]
    fits = F.filter(F.array(F.lit(0), F.when(F.col("sample_id") % 3 != 0, 1), F.when(F.col("sample_id") < 200, 2)), lambda v: v.isNotNull())
    together = fit_logistic(frame.withColumn("fits", fits), NAMES, designs)
    for d, (rows, columns) in enumerate([(np.arange(600) >= 0, [0, 1, 3]), (np.arange(600) % 3 != 0, list(range(6))), (np.arange(600) < 200, [2])]):
        xs, ys = x[rows], y[rows]
        w = (len(ys) / (2 * (ys == 0).sum()), len(ys) / (2 * ys.sum())) if designs[d]["balanced"] else (1.0, 1.0)
        assert together[d].error is None and together[d].steps < 30
        assert gradient(together[d], xs, ys, columns, designs[d]["C"], w) < 1e-6
        only = F.filter(F.array(F.when(F.array_contains(fits, d), 0)), lambda v: v.isNotNull())
        alone = fit_logistic(frame.withColumn("fits", only), NAMES, [designs[d]])[0]
        assert np.abs(np.array(alone.coefficients) - together[d].coefficients).max() < 1e-6
    assert together[1].coefficients[5] == 0.0


def test_designs_without_two_classes_or_with_nulls_carry_an_error(frame):
    df = frame.withColumn("a", F.when(F.col("sample_id") != 7, F.col("a")))
    fits = F.filter(F.array(F.when(F.col("label") == 1, 0), F.when(F.col("sample_id") < 100, 1), F.when(F.col("sample_id") > 100, 2)), lambda v: v.isNotNull())
    models = fit_logistic(df.withColumn("fits", fits), NAMES, [{"C": 1.0}, {"C": 1.0}, {"C": 1.0}])
    assert [m.error is None for m in models] == [False, False, True]
    assert "classes" in models[0].error and "null" in models[1].error
    designs = [L.Design(r, "boosted", "x", 0, {"trees": 2, "depth": 2, "rate": 0.1, "balanced": False}, tuple(NAMES)) for r in ("0", "1")]
    grown = L.fit(frame, designs, L.where(designs, lambda r: (F.col("label") == 1) if r == "0" else F.col("sample_id") >= 0))
    assert grown[0].error and grown[1].error is None
    scored = L.score(frame, grown, None, ["label"])
    tuning = L.tuning_table(scored, designs, grown).orderBy("model").collect()
    assert [t.status for t in tuning] == ["failed", "ok"] and [t.selected for t in tuning] == [False, True]
    with pytest.raises(ValueError, match="no candidate"):
        L.winners([t.asDict() for t in tuning])


def test_trees_over_spark_equal_trees_inside_tasks(frame):
    """A bound of zero bytes sends every level through the grouped sums; draws, splits and values stay the same."""
    designs = [L.Design("r", "boosted", "b", 0, {"trees": 11, "depth": 3, "rate": 0.3, "balanced": True}, tuple(NAMES), 5),
               L.Design("s", "boosted", "c", 0, {"trees": 3, "depth": 2, "rate": 0.3, "balanced": False}, ("a", "d"), 6),
               L.Design("r", "rf", "f", 0, {"trees": 4, "depth": 7, "leaf": 3, "balanced": False}, tuple(NAMES), 7)]
    fits = L.where(designs, lambda r: F.col("sample_id") >= 0 if r == "r" else F.col("sample_id") % 2 == 0)
    local = L.fit(frame, designs, fits)
    spread = L.fit(frame, designs, fits, local_bytes=0)
    for a, b in zip(local, spread):
        assert len(a.trees) == len(b.trees)
        for s, t in zip(a.trees, b.trees):
            assert np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.array_equal(s.left, t.left)
            assert np.allclose(s.value, t.value, atol=1e-9)


def test_ensembles_learn_an_interaction_and_forests_keep_their_leaf_size(frame):
    x, y = data()
    designs = L.grid_designs(["r"], NAMES, ("rf", "boosted"))
    few = [L.Design(d.run, d.family, d.candidate, d.place, {**d.params, "trees": 40 if d.family == "rf" else 300}, d.features) for d in designs]
    models = L.fit(frame, few, L.where(few, lambda r: F.col("sample_id") < 450))
    for d, m in zip(few, models):
        p = m.probabilities(x[450:], NAMES)
        assert (p >= 0).all() and (p <= 1).all() and ((p >= 0.5) == y[450:]).mean() > 0.72, d.candidate
    forest = models[2]
    bins = T.to_bins(x[:450], forest.cuts)
    assert max(np.bincount(t.leaves(bins)).max() for t in forest.trees) < 450 and len(forest.trees) == 40


def test_sorted_and_binned_split_search_agree():
    rng = np.random.default_rng(5)
    for boosted in (True, False):
        rule = T.Rule(boosted, 1, 4, 2, 0.1, 9, tuple(range(9)), (1.0, 1.5), 0.0)
        node = np.sort(np.concatenate([np.arange(12), rng.integers(0, 12, 200)]))
        bins = rng.integers(0, 40, (len(node), 9)).astype(np.uint8)
        sums = np.column_stack([rng.normal(size=len(node)), rng.uniform(0.1, 0.3, len(node)), rng.integers(1, 3, len(node)).astype(float)])
        allowed = rule.allowed(0, np.arange(12))
        a = rule.best(T.histogram(bins, node, allowed, *sums.T))
        b = rule.best_sorted(bins, node, 12, allowed, sums)
        good = a[0] > 0
        assert good.any() and np.allclose(a[0][good], b[0][good], atol=1e-9)
        assert np.array_equal(a[1][good], b[1][good]) and np.array_equal(a[2][good], b[2][good]) and np.allclose(a[3][good], b[3][good])


def test_models_are_stored_and_scored_in_groups(spark, frame, tmp_path):
    designs = L.grid_designs(["r"], NAMES)
    few = [L.Design(d.run, d.family, d.candidate, d.place, {**d.params, **({"trees": 5} if d.family != "lr" else {})}, d.features) for d in designs]
    models = L.fit(frame, few, L.where(few, lambda r: F.col("sample_id") < 450))
    L.save(spark, models, str(tmp_path / "m"))
    again = L.load(spark, str(tmp_path / "m"))
    which = L.where(few, lambda r: F.col("sample_id") >= 450)
    a, b, c = ({(r.sample_id, r.model): r.p for r in L.score(frame, m, which, ["sample_id"], size).collect()} for m, size in ((models, 1 << 30), (again, 1 << 30), (models, 1)))
    assert a == b == c and len(a) == 150 * 9
    assert [m.features for m in L.load(spark, str(tmp_path / "m"), [2, 5])] == [tuple(NAMES)] * 2


def test_bin_cuts_are_exact_and_do_not_depend_on_partitions(spark):
    """More rows than an approximate summary keeps: the cuts are the values of the ranks i / 256 all the same."""
    x = np.random.default_rng(8).normal(size=30_000)
    df = spark.createDataFrame([(float(v), float(round(v))) for v in x] + [(None, float("nan"))], "a double, b double")
    want = np.sort(x)[[-(-i * len(x) // T.BINS) - 1 for i in range(1, T.BINS)]]
    for parts in (3, 11):
        a, b = T.bin_cuts(df.repartition(parts), ["a", "b"])
        assert np.array_equal(a, want) and set(b) <= set(np.round(x)) and len(b) > 3


def test_grown_trees_stay_out_of_the_driver(spark, frame):
    designs = [L.Design("r", f, f, 0, {**L.GRID[f][0][1], "trees": 4}, tuple(NAMES)) for f in ("rf", "boosted")]
    models = L.fit(frame, designs, L.where(designs, lambda r: F.col("sample_id") < 450))
    assert [(m.held, m.size) for m in models] == [((), 4), ((), 4)]
    x, _ = data()
    got = {(r.sample_id, r.model): r.p for r in L.score(frame, models, None, ["sample_id"]).collect()}
    for d, m in enumerate(models):
        assert [got[i, d] for i in range(600)] == list(m.probabilities(x, NAMES))


def test_forests_do_not_depend_on_the_nodes_sorted_at_a_time(monkeypatch):
    """Many small nodes, with and without class weights, against one split search over all of them with three sums."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 9))
    y = (x[:, 0] * x[:, 1] + rng.normal(size=4000) > 0).astype(float)
    bins = (np.argsort(np.argsort(x, axis=0), axis=0) * 256 // 4000).astype(np.uint8)
    for weights in ((1.0, 1.0), (0.75, 1.5)):
        rule = T.Rule(False, 1, 30, 1, 0.1, 3, tuple(range(9)), weights, 0.0)
        bag = rule.draw(np.arange(4000, dtype=np.uint64), 0)
        monkeypatch.setattr(T, "SORTED", 1 << 16)
        with monkeypatch.context() as m:
            m.setattr(T.Rule, "plain", lambda self: False)
            want = T.grow(rule, 0, bins, y, bag, None)
        assert len(want.feature) > 1000
        for nodes in (1, 7, 1024):
            monkeypatch.setattr(T, "SORTED", nodes)
            assert T.grow(rule, 0, bins, y, bag, None).pack() == want.pack()
