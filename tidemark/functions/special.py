"""Distribution functions Spark lacks, as Arrow UDFs over run-level tables (one row per run or test)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .columns import col


def _log_gamma(x):
    """Lanczos approximation, g = 7 (published coefficients)."""
    c = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
         12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
    x = np.asarray(x, float) - 1
    a = c[0] + sum(ci / (x + i) for i, ci in enumerate(c[1:], 1))
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(a)


def _betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction, element-wise."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 1e-300, 1 - 1e-16)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(flip, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def _cp_upper(fp: pd.Series, n: pd.Series, conf: pd.Series) -> pd.Series:
    k, m = fp.to_numpy(float), n.to_numpy(float)
    lo, hi = np.zeros_like(k), np.ones_like(k)
    full = k >= m
    a, b = k + 1, np.where(full, 1.0, m - k)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = _betainc(a, b, mid) < conf.to_numpy(float)
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return pd.Series(np.where(full, 1.0, (lo + hi) / 2))


def clopper_pearson_upper(fp, n, confidence: float = 0.95) -> Column:
    return _cp_upper(col(fp), col(n), F.lit(confidence))


@F.pandas_udf(DoubleType())
def _t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    v, nu = t.to_numpy(float), df.to_numpy(float)
    half = 0.5 * _betainc(nu / 2, 0.5, nu / (nu + v * v))
    return pd.Series(np.where(v >= 0, half, 1 - half))


def t_upper_tail(t, df) -> Column:
    """P(T >= t) for Student's t."""
    return _t_sf(col(t), col(df))


@F.pandas_udf(DoubleType())
def _wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of the signed-rank statistic: exact null counts up to n = 25 without ties, else normal."""
    out = []
    for wi, ni, ti in zip(w, n, ties):
        if ni is None or ni == 0:
            out.append(1.0)
        elif ni <= 25 and ti == 0:
            ni = int(ni)
            counts = np.zeros(ni * (ni + 1) // 2 + 1)
            counts[0] = 1
            for r in range(1, ni + 1):
                counts[r:] = counts[r:] + counts[:-r]
            lower = min(wi, ni * (ni + 1) / 2 - wi)
            out.append(min(1.0, 2 * counts[: int(np.floor(lower)) + 1].sum() / counts.sum()))
        else:
            var = ni * (ni + 1) * (2 * ni + 1) / 24 - ti / 48
            z = (wi - ni * (ni + 1) / 4) / np.sqrt(var) if var > 0 else 0.0
            out.append(float(min(1.0, 2 * _norm_sf(abs(z)))))
    return pd.Series(out, dtype=float)


def _norm_sf(z):
    from math import erfc, sqrt

    return 0.5 * erfc(z / sqrt(2))


def wilcoxon_p(w_plus, n, tie_term) -> Column:
    return _wilcoxon_p(col(w_plus), col(n), col(tie_term))


def kolmogorov_p(stat: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value: the Kolmogorov series as a column expression."""
    lam = stat * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.pow(F.lit(-1.0), k - 1) * F.exp(
        -2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))
