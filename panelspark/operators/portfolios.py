"""Portfolios as weight rows (portfolio_id, asset, weight): returns, algebra, populations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .measures import measure


def equal_weights(series: DataFrame) -> DataFrame:
    return series.select("asset").distinct().withColumn("weight", 1 / F.count("*").over(Window.partitionBy())).select(F.lit("equal").alias("portfolio_id"), "asset", "weight")


def portfolio_returns(series: DataFrame, weights: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(portfolio_id, t, r): the weighted sum of returns, less constant costs and fees.

    A missing return counts 0 under weight 0 and makes the date's return NULL under any other. ``costs`` has
    (portfolio_id, cost): what is subtracted from every date.
    """
    live = weights.where("weight <> 0")
    held = live.groupBy("portfolio_id").agg(F.count("*").alias("held"))
    got = series.join(live, "asset").groupBy("portfolio_id", "t").agg(F.sum(F.col("weight") * F.col("r")).alias("r"), F.count("r").alias("n")).join(held, "portfolio_id")
    got = got.select("portfolio_id", "t", F.when(F.col("n") == F.col("held"), F.col("r")).alias("r"))
    if costs is None:
        return got
    return got.join(costs, "portfolio_id", "left").select("portfolio_id", "t", (F.col("r") - F.coalesce("cost", F.lit(0.0))).alias("r"))


def costs_and_fees(weights: DataFrame, previous: DataFrame, rates: DataFrame) -> DataFrame:
    """(portfolio_id, cost): rates (asset, cost_rate, fee_rate) on the turnover from ``previous`` (asset, previous) and on weights."""
    every = weights.join(previous, "asset", "left").join(rates, "asset", "left")
    cost = F.coalesce("cost_rate", F.lit(0.0)) * F.abs(F.coalesce("previous", F.lit(0.0)) - F.col("weight")) + F.coalesce("fee_rate", F.lit(0.0)) * F.col("weight")
    return every.groupBy("portfolio_id").agg(F.sum(cost).alias("cost"))


def combine(a: DataFrame, b: DataFrame, name: str, sign: int = 1) -> DataFrame:
    """The sum (or difference) of two weight vectors; an asset that one lacks has weight 0 there."""
    both = a.select("asset", "weight").unionAll(b.select("asset", (F.col("weight") * sign).alias("weight")))
    return both.groupBy("asset").agg(F.sum("weight").alias("weight")).select(F.lit(name).alias("portfolio_id"), "asset", "weight")


def scaled(weights: DataFrame, by: Column | float) -> DataFrame:
    return weights.withColumn("weight", F.col("weight") * by)


def mapped(weights: DataFrame, change) -> DataFrame:
    """Every weight through ``change``, a function of a Column: negation, absolute value, rounding, floor, division by a number."""
    return weights.withColumn("weight", change(F.col("weight")).cast("double"))


def moments(weights: DataFrame, mean: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio_id, mean, variance) that the assets' means (asset, mean) and covariances (asset_i, asset_j, v) imply; an asset without a mean counts none."""
    expected = weights.join(mean, "asset").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("mean")).alias("mean"))
    side = lambda s: weights.where("weight <> 0").select("portfolio_id", F.col("asset").alias(f"asset_{s}"), F.col("weight").alias(f"w_{s}"))
    both = side("i").join(cov, "asset_i").join(side("j"), ["portfolio_id", "asset_j"])
    return expected.join(both.groupBy("portfolio_id").agg(F.sum(F.col("w_i") * F.col("w_j") * F.col("v")).alias("variance")), "portfolio_id", "left")


def compare(population: DataFrame, pairs: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """(a, b, dominates): for every pair of portfolio ids (a, b) whether a is at least as good as b in every measure and better in one."""
    side = lambda s: population.select(F.col("portfolio_id").alias(s), *(F.col(m).alias(f"{s}_{m}") for m in higher + lower))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    good = [F.col(f"a_{m}") - F.col(f"b_{m}") for m in higher] + [F.col(f"b_{m}") - F.col(f"a_{m}") for m in lower]
    return both.select("a", "b", ((F.least(*good, F.lit(0.0)) >= 0) & (F.greatest(*good, F.lit(0.0)) > 0)).alias("dominates"))


def weights_by_date(weights: DataFrame, tested: DataFrame) -> DataFrame:
    """(split_id, t, asset, weight): the weights of each split's portfolio on each of its test dates (split_id, t)."""
    return tested.select("split_id", "t").join(weights.select("split_id", "asset", "weight"), "split_id").select("split_id", "t", "asset", "weight")


def composition(weights: DataFrame) -> DataFrame:
    """Non-zero weights with their rank by falling weight."""
    rank = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("weight"), "asset"))
    return weights.where("weight <> 0").select("portfolio_id", "asset", "weight", rank.alias("rank"))


def effective_assets(weights: DataFrame) -> DataFrame:
    return weights.groupBy("portfolio_id").agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_number_assets"))


def contribution(series: DataFrame, weights: DataFrame, name: str, step: float = 1e-5) -> DataFrame:
    """weight * (measure(w + h) - measure(w - h)) / 2h per asset.

    Moving one weight by h moves the portfolio's return by h times the asset's, so a portfolio's own returns and
    those of its assets are all that is needed: two rows per asset and date, whatever the width.
    """
    live = weights.where("weight <> 0")
    base = portfolio_returns(series, weights).withColumnRenamed("r", "whole")
    each = series.join(live.select("portfolio_id", "asset"), "asset").join(base, ["portfolio_id", "t"])
    moved = each.select("portfolio_id", "asset", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), "t", "whole", "r")
    moved = moved.select("portfolio_id", "asset", "side", "t", (F.col("whole") + F.col("side") * step * F.col("r")).alias("r"))
    values = measure(moved, [name], ["portfolio_id", "asset", "side"])
    slopes = values.groupBy("portfolio_id", "asset").agg((F.sum(F.col("side") * F.col(name)) / (2 * step)).alias("slope"))
    return live.join(slopes, ["portfolio_id", "asset"]).select("portfolio_id", "asset", (F.col("weight") * F.col("slope")).alias("contribution"))


def diversification(series: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted deviations of the assets over the portfolio's deviation."""
    own = series.groupBy("asset").agg(F.stddev_pop("r").alias("sd"))
    top = weights.join(own, "asset").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("sd")).alias("top"))
    whole = measure(portfolio_returns(series, weights), ["standard_deviation"], ["portfolio_id"])
    return top.join(whole, "portfolio_id").select("portfolio_id", F.try_divide("top", "standard_deviation").alias("diversification"))


def sric(series: DataFrame, weights: DataFrame) -> DataFrame:
    """Sharpe ratio less the number of assets over the number of observations times the ratio."""
    r = portfolio_returns(series, weights)
    s = r.groupBy("portfolio_id").agg((F.avg("r") / F.stddev_samp("r")).alias("sharpe"), F.count("r").alias("n"))
    size = weights.groupBy("portfolio_id").agg(F.count("*").alias("assets"))
    return s.join(size, "portfolio_id").select("portfolio_id", (F.col("sharpe") - F.try_divide(F.col("assets"), F.col("n") * F.col("sharpe"))).alias("sric"))


def multi_period(periods: DataFrame) -> DataFrame:
    """Concatenates the periods' returns (portfolio_id, period_id, t, r); ``in_order`` says whether each begins after the one before it has ended."""
    ends = periods.groupBy("portfolio_id", "period_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = ends.withColumn("in_order", F.coalesce(F.col("first") > F.lag("last").over(Window.partitionBy("portfolio_id").orderBy("period_id")), F.lit(True)))
    return periods.join(ends.select("portfolio_id", "period_id", "in_order"), ["portfolio_id", "period_id"])


# Populations: rows (portfolio_id, measures...) ------------------------------------------------------


def quantile(population: DataFrame, by: str, q: float) -> DataFrame:
    """The portfolio at place max(0, round(n * q) - 1) of the rising order, halves rounded to even."""
    over = Window.orderBy(by, "portfolio_id")
    ranked = population.where(F.col(by).isNotNull()).withColumn("_k", F.row_number().over(over) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return ranked.where(F.col("_k") == F.greatest(F.lit(0), F.bround(F.col("_n") * q).cast("int") - 1)).drop("_k", "_n")


def extremes(population: DataFrame, by: str) -> DataFrame:
    return population.agg(F.min_by("portfolio_id", by).alias("least"), F.max_by("portfolio_id", by).alias("most"), F.avg(by).alias("mean"), F.stddev_pop(by).alias("deviation"))


def _undominated(values: np.ndarray) -> np.ndarray:
    """Which rows no other beats: at least as good in every column, all to be raised, and better in one. NaN beats nothing and is not beaten."""
    keep = np.ones(len(values), dtype=bool)
    for a in range(0, len(values), 512):
        x = values[a : a + 512, None, :]
        keep[a : a + 512] = ~((values >= x).all(axis=2) & (values > x).any(axis=2)).any(axis=1)
    return keep


def first_front(population: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """Portfolios that no other dominates: at least as good in every measure and better in one.

    Each partition keeps its own front, and fronts are merged in falling numbers of partitions: a portfolio that is dominated anywhere
    is dominated by one of the front, so nothing that matters is lost, and no two populations are joined.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            both = pdf if held is None else pd.concat([held, pdf])
            values = np.concatenate([both[higher].to_numpy(float), -both[lower].to_numpy(float)], axis=1)
            held = both[_undominated(values)]
        if held is not None:
            yield held

    out = population.mapInPandas(local, population.schema)
    for parts in (8, 1):
        out = out.repartition(parts).mapInPandas(local, population.schema)
    return out


def fronts(population: DataFrame, higher: list[str], lower: list[str], most: int | None = None) -> DataFrame:
    """All Pareto fronts, from 0, peeled until nothing is left; a caller may ask for the first ``most`` only.

    Each front and what it leaves is written once, so that plans do not grow with the number of fronts.
    """
    left, out, k = cut(population, "population"), None, 0
    while out is None or (not left.isEmpty() and (most is None or k < most)):
        front = cut(first_front(left, higher, lower).withColumn("front", F.lit(k)), "front")
        out = front if out is None else out.unionByName(front)
        beyond = left.alias("l").join(front.select("portfolio_id").alias("f"), F.col("l.portfolio_id").eqNullSafe(F.col("f.portfolio_id")), "left_anti")
        left, k = cut(beyond, "population"), k + 1
    return out
