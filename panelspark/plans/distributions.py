"""Distributions of one asset's returns by greatest likelihood: normal, Student's t, Johnson's S_U. Each asset's dates are one task's."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "asset string, family string, loc double, scale double, shape_a double, shape_b double, log_likelihood double, aic double, bic double"


def nelder_mead(f, start: np.ndarray, size: float = 0.5, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """The lowest point that a simplex finds: reflect the worst corner, stretch or contract, else shrink to the best."""
    points = [np.array(start, dtype=float)] + [start + size * e for e in np.eye(len(start))]
    values = [f(x) for x in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        at = lambda k: centre + k * (centre - points[-1])  # noqa: B023, E731
        tried = at(1.0)
        value = f(tried)
        if value < values[0]:
            far = at(2.0)
            beyond = f(far)
            tried, value = (far, beyond) if beyond < value else (tried, value)
        elif value >= values[-2]:
            near = at(0.5 if value < values[-1] else -0.5)
            inside = f(near)
            if inside < min(value, values[-1]):
                tried, value = near, inside
            else:
                points = [points[0]] + [points[0] + (x - points[0]) / 2 for x in points[1:]]
                values = [values[0]] + [f(x) for x in points[1:]]
                continue
        points[-1], values[-1] = tried, value
    return points[int(np.argmin(values))]


def normal_likelihood(x: np.ndarray) -> tuple[float, float, float | None, float | None, float]:
    scale = x.std()
    return x.mean(), scale, None, None, -len(x) / 2 * (math.log(2 * math.pi * scale * scale) + 1)


def student_density(x: np.ndarray, loc: float, scale: float, freedom: float) -> np.ndarray:
    z = (x - loc) / scale
    return math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2) - 0.5 * math.log(freedom * math.pi) - math.log(scale) - (freedom + 1) / 2 * np.log1p(z * z / freedom)


def student_likelihood(x: np.ndarray) -> tuple[float, float, float | None, float | None, float]:
    """(loc, scale, degrees of freedom, none, log-likelihood)."""
    loc, scale = float(np.median(x)), x.std()
    miss = lambda q: -float(student_density(x, loc + scale * q[0], scale * math.exp(q[1]), math.exp(min(q[2], 14.0))).sum())
    q = nelder_mead(miss, np.array([0.0, 0.0, 1.5]))
    return loc + scale * q[0], scale * math.exp(q[1]), math.exp(min(q[2], 14.0)), None, -miss(q)


def johnson_density(x: np.ndarray, a: float, b: float, loc: float, scale: float) -> np.ndarray:
    z = (x - loc) / scale
    y = a + b * np.arcsinh(z)
    return math.log(b) - math.log(scale) - 0.5 * np.log1p(z * z) - 0.5 * math.log(2 * math.pi) - y * y / 2


def johnson_likelihood(x: np.ndarray) -> tuple[float, float, float | None, float | None, float]:
    """(loc, scale, a, b, log-likelihood)."""
    loc, scale = float(np.median(x)), x.std()

    def miss(q: np.ndarray) -> float:
        if np.abs(q).max() > 15:
            return math.inf
        return -float(johnson_density(x, q[0], math.exp(q[1]), loc + scale * q[2], scale * math.exp(q[3])).sum())

    q = nelder_mead(miss, nelder_mead(miss, np.array([0.0, 0.5, 0.0, 0.5])))
    return loc + scale * q[2], scale * math.exp(q[3]), q[0], math.exp(q[1]), -miss(q)


#: Families with the number of their parameters.
FAMILIES = {"normal": (normal_likelihood, 2), "student_t": (student_likelihood, 3), "johnson_su": (johnson_likelihood, 4)}


def fit(series: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """(asset, family, loc, scale, shape_a, shape_b, log_likelihood, aic, bic, best): every family for every asset, ``best`` by AIC.

    Missing returns are left out; an asset without two different returns has no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = np.sort(pdf["r"].dropna().to_numpy(float)), []
        if len(x) > 1 and x[0] < x[-1]:
            for name in families:
                solve, count = FAMILIES[name]
                loc, scale, a, b, likelihood = solve(x)
                out.append((pdf["asset"].iloc[0], name, loc, scale, a, b, likelihood, 2 * count - 2 * likelihood, count * math.log(len(x)) - 2 * likelihood))
        return pd.DataFrame(out, columns=["asset", "family", "loc", "scale", "shape_a", "shape_b", "log_likelihood", "aic", "bic"]).astype({"shape_a": float, "shape_b": float})

    found = series.select("asset", "r").groupBy("asset").applyInPandas(run, SCHEMA)
    known = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
    return found.select("asset", "family", "loc", "scale", known("shape_a"), known("shape_b"), "log_likelihood", "aic", "bic").withColumn("best", F.row_number().over(Window.partitionBy("asset").orderBy("aic", "family")) == 1)
