"""Cross-sectional operators: per date, across assets, on (t, asset, x, w, grp)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Median absolute deviation to standard deviation of a normal variable.
MAD_TO_SD = 1.4826022185056018


def at_date() -> WindowSpec:
    return Window.partitionBy("t")


def _used() -> Column:
    """The estimation universe: a value and a positive weight."""
    return F.col("x").isNotNull() & (F.coalesce("w", F.lit(1.0)) > 0)


def _moments(x: Column, over) -> tuple[Column, Column, Column]:
    used = _used()
    mean = F.try_divide(F.sum(F.when(used, x * F.coalesce("w", F.lit(1.0)))).over(over), F.sum(F.when(used, F.coalesce("w", F.lit(1.0)))).over(over))
    return mean, F.stddev_samp(F.when(used, x)).over(over), F.count(F.when(used, x)).over(over)


def zscore(data: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(x - weighted mean) / equal-weighted deviation; 0 where there is none."""
    mean, sd, _ = _moments(F.col("x"), at_date())
    return data.withColumn("z", F.when(F.col("x").isNotNull(), F.when(sd > tolerance, (F.col("x") - mean) / sd).otherwise(0.0)))


def zscore_grouped(data: DataFrame, least: int = 8, tolerance: float = 1e-12) -> DataFrame:
    """As ``zscore`` within groups, those below ``least`` members or labelled -1 against the whole date, then scaled anew over the date."""
    mean, sd, _ = _moments(F.col("x"), at_date())
    gmean, gsd, gcount = _moments(F.col("x"), Window.partitionBy("t", "grp"))
    s = data.withColumn("_own", (F.col("grp") >= 0) & (gcount >= least)).withColumn("_m", F.when(F.col("_own"), gmean).otherwise(mean)).withColumn("_s", F.when(F.col("_own"), gsd).otherwise(sd))
    s = s.withColumn("_z", F.when(F.col("x").isNotNull(), F.when(F.col("_s") > tolerance, (F.col("x") - F.col("_m")) / F.col("_s")).otherwise(0.0)))
    mean, sd, _ = _moments(F.col("_z"), at_date())
    return s.withColumn("z", F.when(F.col("_z").isNotNull(), F.when(sd > tolerance, (F.col("_z") - mean) / sd).otherwise(0.0))).drop("_own", "_m", "_s", "_z")


def _midrank(keys: list[str]) -> tuple[Column, Column]:
    used = F.when(_used(), 1).otherwise(0)
    upto = F.sum(used).over(Window.partitionBy(*keys).orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(used).over(Window.partitionBy(*keys, "x"))
    count = F.sum(used).over(Window.partitionBy(*keys))
    share = F.try_divide(upto - ties / 2, count)
    return F.greatest(0.5 / count, F.least(1 - 0.5 / count, share)), count


def percentile_rank(data: DataFrame) -> DataFrame:
    """Midrank percentile against the date's estimation universe, kept half a rank from 0 and 1."""
    return data.where("x is not null").withColumn("rank", _midrank(["t"])[0])


def percentile_rank_grouped(data: DataFrame, least: int = 8) -> DataFrame:
    own, count = _midrank(["t", "grp"])
    return data.where("x is not null").withColumn("rank", F.when((F.col("grp") >= 0) & (count >= least), own).otherwise(_midrank(["t"])[0]))


def gaussian_rank(data: DataFrame) -> DataFrame:
    """The normal quantile of the percentile rank, centred and scaled over the date."""
    from ..functions.special import normal_quantile

    s = percentile_rank(data).withColumn("x", normal_quantile(F.col("rank"))).drop("rank")
    return zscore(s).select("t", "asset", "z")


def winsorize(data: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond linearly interpolated percentiles of the date's estimation universe come back to them."""
    bounds = data.where(_used()).groupBy("t").agg(F.percentile("x", F.lit(low)).alias("_low"), F.percentile("x", F.lit(high)).alias("_high"))
    return data.join(bounds, "t").withColumn("y", F.when(F.col("x").isNotNull(), F.greatest("_low", F.least("_high", "x")))).drop("_low", "_high")


def tanh_shrink(data: DataFrame, knee: float = 3.0, tolerance: float = 1e-12) -> DataFrame:
    """median + h * tanh((x - median) / h) with h = knee * the scaled median absolute deviation; unchanged where there is none."""
    used = data.where(_used())
    centre = used.groupBy("t").agg(F.median("x").alias("_c"))
    spread = used.join(centre, "t").groupBy("t").agg((F.median(F.abs(F.col("x") - F.col("_c"))) * MAD_TO_SD).alias("_s"))
    h = F.col("_s") * knee
    shrunk = F.col("_c") + h * F.tanh((F.col("x") - F.col("_c")) / h)
    return data.join(centre, "t").join(spread, "t").withColumn("y", F.when(F.col("_s") > tolerance, shrunk).otherwise(F.col("x"))).drop("_c", "_s")


def weighted_correlation(data: DataFrame, y: str = "y", least: int = 3) -> DataFrame:
    """Weighted Pearson correlation of x and ``y`` per date over rows that have both; NULL below ``least`` rows."""
    s = data.where(F.col("x").isNotNull() & F.col(y).isNotNull() & (F.col("w") > 0))
    total = F.sum("w").over(at_date())
    s = s.withColumn("_x", F.col("x") - F.sum(F.col("w") * F.col("x")).over(at_date()) / total).withColumn("_y", F.col(y) - F.sum(F.col("w") * F.col(y)).over(at_date()) / total)
    part = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    return s.groupBy("t").agg(F.when(F.count("*") >= least, F.try_divide(part("_x", "_y"), F.sqrt(part("_x", "_x") * part("_y", "_y")))).alias("corr"))


def rank_correlation(data: DataFrame, y: str = "y", least: int = 3) -> DataFrame:
    """Pearson correlation of ordinal ranks per date; ties in the order of assets."""
    s = data.where(F.col("x").isNotNull() & F.col(y).isNotNull())
    s = s.withColumn("_x", F.row_number().over(at_date().orderBy("x", "asset"))).withColumn("_y", F.row_number().over(at_date().orderBy(y, "asset")))
    return s.groupBy("t").agg(F.when(F.count("*") >= least, F.corr("_x", "_y")).alias("corr"))


def regression(data: DataFrame, y: str = "y") -> DataFrame:
    """Weighted least squares of ``y`` on x with intercept, per date: slope, intercept, weighted R squared; by sums alone."""
    s = data.where(F.col("x").isNotNull() & F.col(y).isNotNull() & (F.col("w") > 0))
    total = F.sum("w").over(at_date())
    s = s.withColumn("_mx", F.sum(F.col("w") * F.col("x")).over(at_date()) / total).withColumn("_my", F.sum(F.col("w") * F.col(y)).over(at_date()) / total)
    dx, dy, w = F.col("x") - F.col("_mx"), F.col(y) - F.col("_my"), F.col("w")
    g = s.groupBy("t").agg(F.sum(w * dx * dx).alias("xx"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dy * dy).alias("yy"), F.first("_mx").alias("mx"), F.first("_my").alias("my"))
    slope = F.try_divide("xy", "xx")
    return g.select("t", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")).alias("r2"))


def regression_on(data: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """(t, intercept, b_<feature>..., r2): weighted least squares of ``y`` on several features per date.

    Spark sums the products of each date; only those, a few numbers a date, are solved in Python. Features that are not independent get the shortest solution.
    """
    k = len(features)
    rows = data.where(F.col(y).isNotNull() & (F.col("w") > 0))
    for f in features:
        rows = rows.where(F.col(f).isNotNull())
    mean = lambda c: (F.sum(F.col("w") * F.col(c)).over(at_date()) / F.sum("w").over(at_date()))
    names = [*features, y]
    rows = rows.select("t", "w", *(mean(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.col(c).alias(f"x{i}") for i, c in enumerate(names)))
    centred = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(k + 1)]
    sums = rows.groupBy("t").agg(F.array(*(F.first(f"m{i}") for i in range(k + 1))).alias("m"), F.array(*(F.sum(F.col("w") * a * b) for a in centred for b in centred)).alias("s"))

    def solve(parts):
        for pdf in parts:
            out = []
            for t, m, s in zip(pdf["t"], pdf["m"], pdf["s"], strict=True):
                s = np.asarray(s, dtype=float).reshape(k + 1, k + 1)
                b = np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)[0]
                out.append((t, m[k] - b @ np.asarray(m[:k]), *b, b @ s[:k, k] / s[k, k] if s[k, k] else None))
            yield pd.DataFrame(out, columns=["t", "intercept", *(f"b_{f}" for f in features), "r2"])

    kind = dict(data.dtypes)["t"]
    return sums.mapInPandas(solve, f"t {kind}, intercept double, " + ", ".join(f"`b_{f}` double" for f in features) + ", r2 double")
