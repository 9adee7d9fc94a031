"""Ellipsoids around means and covariances: a radius from the chi-squared distribution and a shape (asset_i, asset_j, v) from Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrices as mx
from .splits import stationary_bootstrap


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        b += 2
        n = -i * (i - a)
        d, c = n * d + b, b + n / c
        d, c = 1 / (d or tiny), c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def chi2_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, freedom + 10.0
    while gamma_share(freedom / 2, high / 2) < share:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_share(freedom / 2, middle / 2) < share else (low, middle)
    return (low + high) / 2


def radius(assets: int, confidence: float = 0.95, of_covariance: bool = False) -> float:
    """The root of the quantile with one degree of freedom for each mean, or each entry of the covariance."""
    return math.sqrt(chi2_quantile(confidence, assets * assets if of_covariance else assets))


def mean_set(series: DataFrame, effective: int | None = None, diagonal: bool = True) -> DataFrame:
    """The covariance of the mean: that of returns over the number of dates, or ``effective``."""
    n = effective or series.select("t").distinct().count()
    shape = mx.covariance(series)
    shape = shape.where("asset_i = asset_j") if diagonal else shape
    return shape.withColumn("v", F.col("v") / n)


def covariance_set(series: DataFrame, effective: int | None = None, diagonal: bool = True) -> DataFrame:
    """The variance of every entry of a sample covariance of normal returns: (v_ii * v_jj + v_ij ** 2) / n; with ``diagonal``, as if assets were not correlated."""
    n = effective or series.select("t").distinct().count()
    cov = mx.covariance(series)
    own = cov.where("asset_i = asset_j")
    side = lambda s: own.select(F.col("asset_i").alias(f"asset_{s}"), F.col("v").alias(f"v_{s}"))
    both = F.col("v") * F.col("v")
    both = F.when(F.col("asset_i") == F.col("asset_j"), both).otherwise(0.0) if diagonal else both
    return cov.join(side("i"), "asset_i").join(side("j"), "asset_j").select("asset_i", "asset_j", ((F.col("v_i") * F.col("v_j") + both) / n).alias("v"))


def bootstrap_mean_set(indexed: DataFrame, samples: int, block: float, seed: int = 0, diagonal: bool = True) -> DataFrame:
    """The covariance, over resamples in runs, of their means around the panel's."""
    drawn = stationary_bootstrap(indexed, samples, block, seed).groupBy("sample_id", "asset").agg(F.avg("r").alias("m"))
    gaps = drawn.join(indexed.groupBy("asset").agg(F.avg("r").alias("mean")), "asset").select(F.col("sample_id").alias("t"), "asset", (F.col("m") - F.col("mean")).alias("r"))
    shape = mx.covariance(gaps)
    return shape.where("asset_i = asset_j") if diagonal else shape


def bootstrap_covariance_set(indexed: DataFrame, samples: int, block: float, seed: int = 0) -> DataFrame:
    """(asset_i, asset_j, v): the variance, over resamples in runs, of every entry of their covariances."""
    drawn = stationary_bootstrap(indexed, samples, block, seed)
    side = lambda s: drawn.select("sample_id", "place", F.col("asset").alias(f"asset_{s}"), F.col("r").alias(f"r_{s}"))
    each = side("i").join(side("j"), ["sample_id", "place"]).groupBy("sample_id", "asset_i", "asset_j").agg(F.covar_samp("r_i", "r_j").alias("v"))
    return each.groupBy("asset_i", "asset_j").agg(F.var_samp("v").alias("v"))


def block_length(x: np.ndarray) -> float:
    """The mean run of a stationary bootstrap with the least error for the mean of x, by the rule of Politis and White as corrected by Patton.

    Lags count until five (or the logarithm of the length) correlations in a row are within noise; a flat-top window weighs twice as many.
    """
    n, e = len(x), x - x.mean()
    if n < 8 or not e.any():
        return 1.0
    quiet = max(5, int(math.log10(n)))
    most = math.ceil(math.sqrt(n)) + quiet
    bound = 2 * math.sqrt(math.log10(n) / n)
    product = np.array([e[k:] @ e[: n - k] for k in range(min(most, n - 2) + 1)])
    size = np.array([math.sqrt((e[k + 1 :] @ e[k + 1 :]) * (e[: n - k - 1] @ e[: n - k - 1])) for k in range(len(product))])
    small = np.abs(product) < bound * np.where(size > 0, size, np.inf)
    runs = [k for k in range(len(product) - quiet) if small[k : k + quiet].all()]
    m = min(2 * max(runs[0], 1) if runs else most, len(product) - 1)
    lag = np.arange(1, m + 1)
    window = np.where(lag <= m / 2, 1.0, 2 * (1 - lag / m))
    cov = product / n
    slope = 2 * (window * lag * cov[1 : m + 1]).sum()
    level = cov[0] + 2 * (window * cov[1 : m + 1]).sum()
    best = (slope * slope / (level * level)) ** (1 / 3) * n ** (1 / 3) if level else math.inf
    return float(min(best, math.ceil(min(3 * math.sqrt(n), n / 3))))


def block_lengths(series: DataFrame) -> DataFrame:
    """(asset, length), each asset's dates in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["r"].dropna().to_numpy(float)
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "length": [block_length(x) if len(x) else 1.0]})

    return series.select("t", "asset", "r").groupBy("asset").applyInPandas(run, "asset string, length double")
