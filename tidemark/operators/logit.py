"""Logistic fits of a whole design grid: one pass over the rows per Newton step serves every design.

A design is a set of features, a penalty and a class weighting; ``fits`` names on each row the designs that train on
it.  Tasks add up loss, gradient and curvature of each design still at work (37 x 36 / 2 numbers at 35 features), Spark
sums them per (design, cell), and the driver solves systems of that fixed size.  Designs that have converged leave.
The objective is C times the weighted log loss plus half the squared norm of the coefficients of standardised features,
the intercept unpenalised: strictly convex, so the minimum does not depend on the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 2000
TOLERANCE = 1e-9
SUMS = "design int, cell int, value double"


@dataclass(frozen=True)
class Linear:
    """A fitted logistic model in raw units.  ``error`` names why a design has none."""

    features: tuple[str, ...]
    intercept: float = 0.0
    coefficients: tuple[float, ...] = ()
    steps: int = 0
    error: str | None = None

    def probabilities(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = x[:, [names.index(f) for f in self.features]] @ np.array(self.coefficients) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """Rows x features; nulls are NaN."""
    return np.column_stack([np.asarray(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for f in features])


def membership(column: pa.Array, designs: int) -> np.ndarray:
    """Rows x designs, true where the row's list names the design; later designs are left out."""
    out = np.zeros((len(column), designs), bool)
    lists = column.fill_null([]) if column.null_count else column
    sizes = np.array([len(v) for v in lists], int)
    numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(int)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows[numbers < designs], numbers[numbers < designs]] = True
    return out


def summed(df: DataFrame, partial, designs: int) -> dict[int, dict[int, float]]:
    """Sums ``partial(batch) -> {design: vector}`` over all rows: design -> cell -> value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, v in partial(batch).items():
                total[d] = total[d] + v if d in total else v
        for d, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), d, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)],
                                             ["design", "cell", "value"])

    out: dict[int, dict[int, float]] = {d: {} for d in range(designs)}
    # at most designs x cells rows
    for r in df.mapInArrow(run, SUMS).groupBy("design", "cell").agg(F.sum("value").alias("value")).collect():
        out[r.design][r.cell] = r.value
    return out


def _vector(cells: dict[int, float]) -> np.ndarray:
    return np.array([cells[i] for i in range(len(cells))])


class _Newton:
    """Damped Newton steps of one design in standardised units."""

    def __init__(self, columns: list[int], mean: np.ndarray, deviation: np.ndarray, weights: tuple[float, float], c: float):
        self.columns, self.mean, self.deviation, self.weights, self.c = columns, mean, deviation, weights, c
        self.at = self.trial = np.zeros(len(columns) + 1)
        self.step, self.loss, self.steps, self.done = None, np.inf, 0, False

    def partial(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x[:, self.columns] - self.mean) / self.deviation])
        margin = z @ self.trial
        w = np.where(y == 1, self.weights[1], self.weights[0])
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
        loss = (w * (np.logaddexp(0.0, margin) - y * margin)).sum()
        curve = (z * (w * p * (1 - p))[:, None]).T @ z
        return np.concatenate([[loss], z.T @ (w * (p - y)), curve[np.triu_indices(len(curve))]])

    def advance(self, sums: np.ndarray, tolerance: float) -> None:
        k = len(self.at)
        penalty = np.ones(k)
        penalty[0] = 0.0
        loss = self.c * sums[0] + (penalty * self.trial**2).sum() / 2
        self.steps += 1
        if loss <= self.loss + 1e-12 * abs(self.loss) or self.step is None:
            self.at, self.loss = self.trial, loss
            curve = np.zeros((k, k))
            curve[np.triu_indices(k)] = self.c * sums[1 + k:]
            curve = curve + np.triu(curve, 1).T + np.diag(penalty)
            self.step = -np.linalg.lstsq(curve, self.c * sums[1:1 + k] + penalty * self.at, rcond=None)[0]
        else:
            self.step = self.step / 2
        self.trial = self.at + self.step
        self.done = np.abs(self.step).max() <= tolerance * (1 + np.abs(self.at).max())


def fit_logistic(df: DataFrame, features: list[str], designs: list[dict], fits: str = "fits", label: str = "label",
                 most: int = STEPS, tolerance: float = TOLERANCE) -> list[Linear]:
    """One model per design ({"features", "C", "balanced"}); ``df`` (saved or cached) has ``fits``: array of design numbers.

    A design without both classes, or with a null or infinite value in its rows, yields an ``error`` in place of a model.
    """
    n = len(designs)
    df = df.select(fits, label, *features).filter(F.size(fits) > 0)
    first = df.agg(*[F.avg(F.when(F.abs(F.col(f).cast("double")) < 1e300, F.col(f))).alias(f) for f in features]).first()
    shift = np.array([0.0 if v is None else v for v in first])

    def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, y, rows = matrix(batch, features) - shift, batch.column(label).to_numpy(zero_copy_only=False), membership(batch.column(fits), n)
        one, square = np.column_stack([y == 0, y == 1, x]).T @ rows, (x * x).T @ rows
        if not (np.isfinite(one).all() and np.isfinite(square).all()):  # keep a bad value inside the designs that hold it
            one = np.column_stack([np.column_stack([y == 0, y == 1, x])[rows[:, d]].sum(axis=0) for d in range(n)])
            square = np.column_stack([(x * x)[rows[:, d]].sum(axis=0) for d in range(n)])
        return {d: np.concatenate([one[:, d], square[:, d]]) for d in range(n) if rows[:, d].any()}

    out: list[Linear | None] = [None] * n
    work: dict[int, _Newton] = {}
    for d, cells in summed(df, moments, n).items():
        names = tuple(designs[d].get("features") or features)
        columns = [features.index(f) for f in names]
        v = _vector(cells) if cells else np.zeros(2 + 2 * len(features))
        neg, pos, s, q = v[0], v[1], v[2:2 + len(features)][columns], v[2 + len(features):][columns]
        if not neg or not pos:
            out[d] = Linear(names, error="training needs both classes")
        elif not (np.isfinite(s).all() and np.isfinite(q).all()):
            out[d] = Linear(names, error="a feature has null or infinite values")
        else:
            rows = neg + pos
            variance = np.maximum(q / rows - (s / rows) ** 2, 0.0)
            deviation = np.where(variance > 1e-14 * np.maximum(q / rows, 1e-300), np.sqrt(variance), 1.0)
            weights = (rows / (2 * neg), rows / (2 * pos)) if designs[d].get("balanced") else (1.0, 1.0)
            work[d] = _Newton(columns, s / rows + shift[columns], deviation, weights, designs[d]["C"])

    while any(not w.done and w.steps < most for w in work.values()):
        active = {d: w for d, w in work.items() if not w.done and w.steps < most}

        def step(batch: pa.RecordBatch, active=active) -> dict[int, np.ndarray]:
            x, y, rows = matrix(batch, features), batch.column(label).to_numpy(zero_copy_only=False), membership(batch.column(fits), n)
            return {d: w.partial(x[rows[:, d]], y[rows[:, d]]) for d, w in active.items() if rows[:, d].any()}

        for d, cells in summed(df, step, n).items():
            if d in active:
                active[d].advance(_vector(cells), tolerance)
    for d, w in work.items():
        names = tuple(designs[d].get("features") or features)
        beta = w.trial[1:] / w.deviation
        out[d] = Linear(names, float(w.trial[0] - (beta * w.mean).sum()), tuple(float(b) for b in beta), w.steps)
    return out
