"""Special functions that Spark lacks, as Column expressions or NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of a published rational approximation of the normal quantile (P. J. Acklam).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """The approximation, then two steps of Halley's method, which leave rounding errors only."""
    p = np.asarray(p, dtype=float)
    low = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.sqrt(-2 * np.log(low))
        tail = np.polyval(_C, q) / np.polyval((*_D, 1.0), q)
        r = (p - 0.5) ** 2
        body = np.polyval(_A, r) * (p - 0.5) / np.polyval((*_B, 1.0), r)
    x = np.where(low < 0.02425, np.where(p < 0.5, tail, -tail), body)
    for _ in range(2):
        e = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * np.exp(np.minimum(x * x / 2, 700))
        x = np.where((p > 0) & (p < 1), x - e / (1 + x * e / 2), x)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def beta_share(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    x = np.asarray(x, dtype=float)
    turn = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for n in (even, odd):
            d = 1 + n * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + n / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    share = np.where(y <= 0, 0.0, front * h)
    return np.where(turn, 1 - share, share)


def student_cdf(x: np.ndarray, freedom: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    tail = beta_share(freedom / (freedom + x * x), freedom / 2, 0.5) / 2
    return np.where(x > 0, 1 - tail, tail)


def student_ppf(p: np.ndarray, freedom: float) -> np.ndarray:
    """The quantile of Student's t, by Newton steps on the lower tail, in logarithms of tail and of -x.

    There the tail is concave, and below the power of x that the first step starts from, so that steps fall to the root and never pass it.
    """
    p = np.asarray(p, dtype=float)
    tail = np.minimum(p, 1 - p)
    found = (tail > 0) & (tail < 0.5)
    want = np.log(np.where(found, tail, 0.25))
    level = math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2) - 0.5 * math.log(freedom * math.pi)
    s = (level + (freedom - 1) / 2 * math.log(freedom) - want) / freedom
    for _ in range(60):
        x = np.exp(s)
        share = np.maximum(student_cdf(-x, freedom), 1e-300)
        density = np.exp(level - (freedom + 1) / 2 * np.log1p(x * x / freedom))
        step = (want - np.log(share)) * share / (density * x)
        s = s - step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    x = np.where(found, np.exp(s), np.where(tail >= 0.5, 0.0, np.inf))
    return np.where(p < 0.5, -x, x)


def normal_distribution(x: Column) -> Column:
    """``normal_cdf`` of a column, in Arrow batches."""

    @F.pandas_udf("double")
    def distribution(s: pd.Series) -> pd.Series:
        return pd.Series(normal_cdf(s.to_numpy(dtype=float)))

    return distribution(x)


def normal_quantile(p: Column) -> Column:
    """``normal_ppf`` of a column, in Arrow batches."""

    @F.pandas_udf("double")
    def quantile(s: pd.Series) -> pd.Series:
        return pd.Series(normal_ppf(s.to_numpy(dtype=float)))

    return quantile(p)
