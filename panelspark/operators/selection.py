"""Asset pre-selection: which columns of a panel to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import matrices, measures, portfolios


def keep_varying(series: DataFrame, threshold: float = 1e-8) -> DataFrame:
    """Assets whose population variance is above the threshold."""
    return series.groupBy("asset").agg(F.var_pop("r").alias("v")).where(F.col("v") > threshold).select("asset")


def keep_complete(grid: DataFrame, value: str = "price", everywhere: bool = False) -> DataFrame:
    """Assets with a value on the first and on the last date, or on all."""
    g = grid.groupBy("asset").agg(F.min_by(value, "t").isNotNull().alias("first"), F.max_by(value, "t").isNotNull().alias("last"), (F.count(value) == F.count("*")).alias("all"))
    return g.where(F.col("all") if everywhere else F.col("first") & F.col("last")).select("asset")


def keep_unexpired(series: DataFrame, expirations: DataFrame, days: int) -> DataFrame:
    """Assets that end more than ``days`` after the last date; those without an end in ``expirations`` (asset, expires) never do."""
    last = series.agg(F.max("t").alias("last"))
    return series.select("asset").distinct().join(expirations, "asset", "left").join(last).where(F.col("expires").isNull() | (F.col("expires") > F.date_add("last", days))).select("asset")


def keep_extremes(series: DataFrame, by: str, k: int, highest: bool = True) -> DataFrame:
    """The k assets of highest (or lowest) measure or ratio, ties by name."""
    m = measures.measure(series, [by]) if by in measures.MEASURES else measures.ratios(series, [by])
    return m.orderBy(F.desc_nulls_last(by) if highest else F.asc_nulls_last(by), "asset").limit(k).select("asset")


def keep_undominated(series: DataFrame, higher: list[str], lower: list[str], least: int | None = None) -> DataFrame:
    """The assets of the first Pareto fronts, each whole, until they are at least ``least`` (by default the first alone)."""
    m = measures.measure(series, [*higher, *lower]).withColumnRenamed("asset", "portfolio_id")
    if least is None:
        return portfolios.first_front(m, higher, lower).select(F.col("portfolio_id").alias("asset"))
    ranked = portfolios.fronts(m, higher, lower)
    before = F.coalesce(F.sum("c").over(Window.orderBy("front").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = ranked.groupBy("front").agg(F.count("*").alias("c")).withColumn("before", before).where(F.col("before") < least)
    return ranked.join(wanted.select("front"), "front").select(F.col("portfolio_id").alias("asset"))


def keep_uncorrelated(series: DataFrame, threshold: float = 0.95) -> list[str]:
    """Of pairs by falling correlation above the threshold, the asset with the larger mean correlation goes (ties: the second), unless one has gone already.

    The pairs above the threshold and the means, at most assets squared, come to the driver, where the greedy pass is.
    """
    corr = matrices.correlation(series)
    mean = {r["asset_i"]: r["m"] for r in corr.groupBy("asset_i").agg(F.avg("v").alias("m")).collect()}
    gone: set[str] = set()
    for r in corr.where((F.col("asset_i") < F.col("asset_j")) & (F.col("v") > threshold)).orderBy(F.desc("v"), "asset_i", "asset_j").collect():
        i, j = r["asset_i"], r["asset_j"]
        if not gone & {i, j}:
            gone.add(i if mean[i] > mean[j] else j)
    return sorted(set(mean) - gone)
