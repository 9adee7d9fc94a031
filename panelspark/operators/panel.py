"""Panel preparation: returns, fills, filters and joins on long panels (t, asset, price)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_time() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("t")


def linear_returns(panel: DataFrame) -> DataFrame:
    """(t, asset, r): price over the price before, less 1; the first row of an asset goes, a zero price gives no return."""
    r = F.try_divide("price", F.lag("price").over(by_time())) - 1
    return panel.select("t", "asset", r.alias("r")).where("r is not null")


def log_returns(panel: DataFrame) -> DataFrame:
    return linear_returns(panel).withColumn("r", F.log1p("r"))


def full_grid(panel: DataFrame) -> DataFrame:
    """Every (t, asset) that occur anywhere, with NULL where the panel has no price. Both key sets are small dimensions."""
    assets = panel.agg(F.sort_array(F.collect_set("asset")).alias("assets"))
    grid = panel.select("t").distinct().join(assets).select("t", F.explode("assets").alias("asset"))
    return grid.join(panel.select("t", "asset", "price"), ["t", "asset"], "left")


def drop_sparse_rows(grid: DataFrame, threshold: float) -> DataFrame:
    """Drops a date whose number of missing prices is above ``threshold`` times the number of assets."""
    at = Window.partitionBy("t")
    missing, assets = F.sum(F.col("price").isNull().cast("int")).over(at), F.count("*").over(at)
    return grid.withColumn("_m", missing).withColumn("_n", assets).where(F.col("_m") <= F.col("_n") * threshold).drop("_m", "_n")


def forward_fill(grid: DataFrame) -> DataFrame:
    return grid.withColumn("price", F.last("price", ignorenulls=True).over(by_time()))


def drop_inception(grid: DataFrame) -> DataFrame:
    """Drops dates on which any asset still has no price."""
    complete = F.sum(F.col("price").isNull().cast("int")).over(Window.partitionBy("t")) == 0
    return grid.withColumn("_c", complete).where("_c").drop("_c")


def prices_to_returns(panel: DataFrame, threshold: float = 1.0, log: bool = False) -> DataFrame:
    """Sparse dates dropped, gaps filled, dates before every asset has begun dropped, then returns."""
    ready = drop_inception(forward_fill(drop_sparse_rows(full_grid(panel), threshold)))
    return log_returns(ready) if log else linear_returns(ready)


def indexed(panel: DataFrame) -> DataFrame:
    """``obs_idx``: the place of t among all dates, from 0. Dates are few, so one task ranks them."""
    dates = panel.select("t").distinct().withColumn("obs_idx", F.row_number().over(Window.orderBy("t")) - 1)
    return panel.join(dates, "t")


def tail(panel: DataFrame, n: int) -> DataFrame:
    """The last n dates."""
    return panel.join(panel.select("t").distinct().orderBy(F.desc("t")).limit(n), "t", "left_semi")


def join_factors(prices: DataFrame, factors: DataFrame, how: str = "full") -> DataFrame:
    """(t, asset, price, factor): every price with its date's factor (t, factor); ``full`` keeps dates that one side lacks."""
    return prices.select("t", "asset", "price").join(factors.select("t", "factor"), "t", how)


def blocks(indexed_panel: DataFrame, size: int) -> DataFrame:
    """Rows of the last whole blocks of ``size`` dates, aligned to the panel's end, with ``block`` from 0."""
    n = indexed_panel.agg(F.max("obs_idx")).first()[0]
    offset = 0 if n is None else (n + 1) % size
    return indexed_panel.where(F.col("obs_idx") >= offset).withColumn("block", F.floor((F.col("obs_idx") - offset) / size))


def block_volatility(series: DataFrame, size: int) -> DataFrame:
    """(asset, block, volatility): sample deviations of returns in blocks that do not overlap."""
    return blocks(indexed(series), size).groupBy("asset", "block").agg(F.stddev_samp("r").alias("volatility"))


def between(panel: DataFrame, first=None, last=None, assets: list[str] | None = None) -> DataFrame:
    """The panel's rows from ``first`` to ``last`` (both included), of all or some assets; filters that reach the scan."""
    out = panel if first is None else panel.where(F.col("t") >= F.lit(first))
    out = out if last is None else out.where(F.col("t") <= F.lit(last))
    return out if assets is None else out.where(F.col("asset").isin(list(assets)))
