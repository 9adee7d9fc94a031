"""Priors: scenario probabilities under views, moments from factors. Sums over scenarios are Spark's; the driver holds views and matrices of assets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allocation import OptimizationError


def entropy_pooling(scenarios: DataFrame, views: list[tuple[str, float]], rounds: int = 60) -> DataFrame:
    """``scenarios`` with ``q``: the probabilities nearest to ``p`` in relative entropy under which every view's column has its mean.

    ``scenarios`` has p and the columns that ``views`` name. q is p * exp(a . x) normalised; Newton steps on the convex dual find a, each from one
    aggregation of as many sums as there are pairs of views. Raises where no probabilities reach the views.
    """
    names, want, k = [v for v, _ in views], np.array([float(x) for _, x in views]), len(views)
    centre = scenarios.agg(*(F.sum(F.col("p") * F.col(n)).alias(n) for n in names), *(F.stddev_pop(n).alias(f"_{n}") for n in names)).first()
    scale = np.array([centre[f"_{n}"] or 1.0 for n in names])
    middle = np.array([centre[n] for n in names])
    z = [(F.col(n) - float(m)) / float(s) for n, m, s in zip(names, middle, scale, strict=True)]
    goal, a = (want - middle) / scale, np.zeros(k)

    def power(a: np.ndarray):
        total = F.lit(0.0)
        for x, c in zip(z, a, strict=True):
            total = total + x * float(c)
        return total

    def sums(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = F.col("p") * F.exp(power(a))
        found = scenarios.agg(F.sum(w).alias("s"), *(F.sum(w * x).alias(f"g{i}") for i, x in enumerate(z)), *(F.sum(w * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
        s = found["s"]
        g = np.array([found[f"g{i}"] / s for i in range(k)])
        h = np.array([[found[f"h{min(i, j)}_{max(i, j)}"] / s for j in range(k)] for i in range(k)]) - np.outer(g, g)
        return s, g, h

    for _ in range(rounds):
        s, g, h = sums(a)
        if np.abs(goal - g).max() < 1e-10:
            return scenarios.withColumn("q", F.col("p") * F.exp(power(a)) / float(s))
        move = np.linalg.solve(h + 1e-12 * np.eye(k), goal - g)
        a = a + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if not np.isfinite(a).all() or np.abs(a).max() > 500:
            break
    raise OptimizationError("no probabilities of these scenarios meet the views")


def factor_loadings(series: DataFrame, factors: DataFrame, intercept: bool = False) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(assets, factors, loadings, intercepts, residual variances) of least squares of returns (t, asset, r) on factors (t, factor, f).

    Dates need all factors. Products are summed by Spark, factors squared and assets times factors of them, and solved on the driver.
    """
    names = sorted(r["factor"] for r in factors.select("factor").distinct().collect())
    wide = factors.groupBy("t").pivot("factor", names).agg(F.first("f")).dropna().withColumn("_one", F.lit(1.0 if intercept else 0.0))
    columns = [*names, "_one"] if intercept else names
    rows = series.where("r is not null").join(wide, "t")
    xx = [F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"x{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    found = rows.groupBy("asset").agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("yy"), *(F.sum(F.col("r") * F.col(f"`{a}`")).alias(f"y{i}") for i, a in enumerate(columns)), *xx).orderBy("asset").collect()
    assets, k = [r["asset"] for r in found], len(columns)
    b, residual = np.zeros((len(assets), k)), np.zeros(len(assets))
    for row, r in enumerate(found):
        gram = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        y = np.array([r[f"y{i}"] for i in range(k)])
        b[row] = np.linalg.lstsq(gram, y, rcond=None)[0]
        residual[row] = max(0.0, r["yy"] - 2 * b[row] @ y + b[row] @ gram @ b[row]) / max(r["n"] - 1, 1)
    alpha = b[:, -1] if intercept else np.zeros(len(assets))
    return assets, names, b[:, : len(names)], alpha, residual


def factor_model(loadings: np.ndarray, alpha: np.ndarray, residual: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of assets from those of the factors: loadings carry them over, residual variances add to the diagonal."""
    return loadings @ mean + alpha, loadings @ cov @ loadings.T + np.diag(residual)
