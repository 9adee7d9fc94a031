"""How well a forecast covariance (keys, asset_i, asset_j, v) fits returns (keys, t, asset, r) that came later.

A missing return counts for none; variances of sums grow with the dates that assets have, alone and in pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variances below this count as this.
LEAST = 1e-12


def diagonal_calibration(forecast: DataFrame, realised: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, diagonal_ratio, diagonal_loss): the mean over assets of squared summed returns over forecast variance times dates; 1 if calibrated."""
    own = forecast.where("asset_i = asset_j").select(*keys, F.col("asset_i").alias("asset"), "v")
    sums = realised.where("r is not null").groupBy(*keys, "asset").agg(F.sum("r").alias("total"), F.count("r").alias("n"))
    each = own.join(sums, [*keys, "asset"])
    found = each.groupBy(*keys).agg(F.avg(F.col("total") * F.col("total") / (F.col("n") * F.greatest("v", F.lit(LEAST)))).alias("diagonal_ratio"))
    return found.withColumn("diagonal_loss", F.abs(F.col("diagonal_ratio") - 1))


def portfolio_calibration(forecast: DataFrame, realised: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """(keys, portfolio_ratio, portfolio_loss, portfolio_qlike) of one portfolio's realised over forecast variance.

    ``weights`` (keys, asset, weight); without them each asset's inverse forecast volatility, adding up to 1.
    """
    if weights is None:
        inverse = forecast.where("asset_i = asset_j").select(*keys, F.col("asset_i").alias("asset"), (1 / F.sqrt(F.greatest("v", F.lit(LEAST)))).alias("i"))
        whole = inverse.groupBy(*keys).agg(F.sum("i").alias("whole"))
        weights = inverse.join(whole, keys).select(*keys, "asset", (F.col("i") / F.col("whole")).alias("weight"))
    here = realised.where("r is not null").select(*keys, "t", "asset", "r")
    side = lambda s: here.select(*keys, "t", F.col("asset").alias(f"asset_{s}"))
    counts = side("i").join(side("j"), [*keys, "t"]).groupBy(*keys, "asset_i", "asset_j").agg(F.count("*").alias("n"))
    held = lambda s: weights.select(*keys, F.col("asset").alias(f"asset_{s}"), F.col("weight").alias(f"w_{s}"))
    both = forecast.join(counts, [*keys, "asset_i", "asset_j"]).join(held("i"), [*keys, "asset_i"]).join(held("j"), [*keys, "asset_j"])
    expected = both.groupBy(*keys).agg(F.greatest(F.sum(F.col("w_i") * F.col("w_j") * F.col("n") * F.col("v")), F.lit(LEAST)).alias("expected"))
    dates = here.join(weights, [*keys, "asset"]).groupBy(*keys, "t").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    got = dates.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("got")).join(expected, keys)
    ratio = F.col("got") / F.col("expected")
    return got.select(*keys, ratio.alias("portfolio_ratio"), F.abs(ratio - 1).alias("portfolio_loss"), (F.log("expected") + ratio).alias("portfolio_qlike"))


def mahalanobis_calibration(forecast: DataFrame, realised: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mahalanobis_ratio, mahalanobis_loss): the squared distance of the summed returns to 0 under the covariance times dates, over the number of assets.

    Each key's matrix is solved in a task of its own, which holds its assets squared.
    """
    here = realised.where("r is not null").select(*keys, "t", "asset", "r")
    sums = here.groupBy(*keys, F.col("asset").alias("asset_i")).agg(F.sum("r").alias("total"))
    side = lambda s: here.select(*keys, "t", F.col("asset").alias(f"asset_{s}"))
    counts = side("i").join(side("j"), [*keys, "t"]).groupBy(*keys, "asset_i", "asset_j").agg(F.count("*").alias("n"))
    cells = forecast.join(sums, [*keys, "asset_i"]).join(counts, [*keys, "asset_i", "asset_j"], "left").select(*keys, "asset_i", "asset_j", "total", (F.col("v") * F.coalesce("n", F.lit(0))).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in forecast.schema}

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf.groupby("asset_i")["total"].first()
        cov = pdf.pivot(index="asset_i", columns="asset_j", values="v").reindex(index=total.index, columns=total.index).to_numpy(float)
        ratio = float(total.to_numpy() @ np.linalg.lstsq(cov, total.to_numpy(), rcond=None)[0]) / len(total)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "mahalanobis_ratio": [ratio], "mahalanobis_loss": [abs(ratio - 1)]})

    return cells.groupBy(*keys).applyInPandas(solved, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mahalanobis_ratio double, mahalanobis_loss double")
