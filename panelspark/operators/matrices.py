"""Moments and distances as long matrices (asset_i, asset_j, value): pairs meet by an equi-join on t."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .panel import blocks, indexed

#: Assets in a block of a tile.
WIDE = 64


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset")


def pairs(series: DataFrame, *columns: str) -> DataFrame:
    """Rows of every two assets at a time with suffixes _i and _j; assets are the columns of a panel, so pairs per date are bounded by its width."""
    side = lambda s: series.select("t", F.col("asset").alias(f"asset{s}"), *(F.col(c).alias(c + s) for c in columns))
    return side("_i").join(side("_j"), "t")


def covariance(series: DataFrame) -> DataFrame:
    return pairs(series, "r").groupBy("asset_i", "asset_j").agg(F.covar_samp("r_i", "r_j").alias("v"))


def correlation(series: DataFrame) -> DataFrame:
    return pairs(series, "r").groupBy("asset_i", "asset_j").agg(F.corr("r_i", "r_j").alias("v"))


def to_distance(corr: Column, absolute: bool = False, power: int = 1) -> Column:
    """sqrt(s * (1 - corr ** power)) within 0 and 1, s scaling its range: 1/2 for signed odd powers, else 1."""
    x = F.pow(F.abs(corr) if absolute else corr, F.lit(power))
    s = 0.5 if power % 2 and not absolute else 1.0
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * (1 - x))))


def pearson_distance(series: DataFrame) -> DataFrame:
    return correlation(series).withColumn("v", to_distance(F.col("v")))


def midranks(series: DataFrame, keys: list[str]) -> DataFrame:
    """Average-tie ranks of r within keys."""
    over = Window.partitionBy(*keys)
    return series.withColumn("r", F.rank().over(over.orderBy("r")) + (F.count("*").over(Window.partitionBy(*keys, "r")) - 1) / 2)


def spearman_distance(series: DataFrame) -> DataFrame:
    return pearson_distance(midranks(series, ["asset"]))


def tiled(series: DataFrame, compute) -> DataFrame:
    """(asset_i, asset_j, v) for every two assets, both ways, by ``compute(x, y, same)`` on blocks of assets.

    x and y are matrices (assets of a block, dates) on shared dates, NaN where a return is missing. A tile holds two
    blocks of at most about ``WIDE`` assets, so each asset travels once for every ``WIDE`` others.
    """
    date = F.col("t").cast("timestamp").cast("long")
    rows = series.groupBy("asset").agg(F.collect_list(F.struct(date.alias("t"), F.col("r"))).alias("s"))
    blocks = rows.count() // WIDE + 1
    at = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("at", at).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("asset", "s", "at", F.least("at", "to").alias("a"), F.greatest("at", "to").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset")
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        dates = np.unique(np.concatenate([[x["t"] for x in s] for s in pdf["s"]]))
        full = np.full((len(pdf), len(dates)), np.nan)
        for k, s in enumerate(pdf["s"]):
            full[k, np.searchsorted(dates, [x["t"] for x in s])] = [np.nan if x["r"] is None else x["r"] for x in s]
        names, block = pdf["asset"].to_numpy(), pdf["at"].to_numpy()
        i, j = np.flatnonzero(block == a), np.flatnonzero(block == b)
        v = compute(full[i], full[j])
        out = pd.DataFrame({"asset_i": np.repeat(names[i], len(j)), "asset_j": np.tile(names[j], len(i)), "v": v.ravel()})
        return out if a == b else pd.concat([out, out.rename(columns={"asset_i": "asset_j", "asset_j": "asset_i"})])

    return dealt.groupBy("a", "b").applyInPandas(run, "asset_i string, asset_j string, v double").withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def inversions(y: np.ndarray) -> int:
    """Pairs of places whose later value is smaller, by merging sorted halves of doubling width."""
    n = len(y)
    _, rank = np.unique(y, return_inverse=True)
    size = 1 << max(0, n - 1).bit_length()
    x = np.r_[rank, np.full(size - n, n)].astype(np.int64)
    total, width = 0, 1
    while width < size:
        halves = x.reshape(-1, 2, width)
        block = np.arange(len(halves))[:, None] * (n + 2)
        left = (halves[:, 0] + block).ravel()
        right = (halves[:, 1] + block).ravel()
        upto = np.searchsorted(left, right, side="right") - np.repeat(np.arange(len(halves)) * width, width)
        total += int((width - upto).sum())
        x, width = np.sort(halves.reshape(len(halves), -1), axis=1).ravel(), width * 2
    return total


def _tied(*columns: np.ndarray) -> int:
    _, c = np.unique(np.stack(columns), axis=1, return_counts=True)
    return int((c * (c - 1) // 2).sum())


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b in n log n: pairs less ties less twice the inversions of y in the order of x."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    n = len(x) * (len(x) - 1) // 2
    tx, ty, txy = _tied(x), _tied(y), _tied(x, y)
    scale = np.sqrt(float(n - tx) * float(n - ty))
    return (n - tx - ty + txy - 2 * inversions(y[np.lexsort((y, x))])) / scale if scale else np.nan


def kendall(series: DataFrame) -> DataFrame:
    """tau-b of every two assets over the dates that both have."""
    return tiled(series, lambda x, y: np.array([[kendall_tau(p, q) for q in y] for p in x]))


def kendall_distance(series: DataFrame) -> DataFrame:
    return kendall(series).withColumn("v", to_distance(F.col("v")))


def covariance_distance(cov: DataFrame, absolute: bool = False, power: int = 1) -> DataFrame:
    """The distance of the correlations that any covariance (asset_i, asset_j, v) implies."""
    own = cov.where("asset_i = asset_j").select(F.col("asset_i").alias("asset"), F.sqrt("v").alias("sd"))
    side = lambda s: own.select(F.col("asset").alias(f"asset_{s}"), F.col("sd").alias(f"sd_{s}"))
    both = cov.join(side("i"), "asset_i").join(side("j"), "asset_j")
    return both.select("asset_i", "asset_j", to_distance(F.try_divide("v", F.col("sd_i") * F.col("sd_j")), absolute, power).alias("v"))


def _centred_distances(x: np.ndarray) -> np.ndarray:
    d = np.abs(x[:, None] - x[None, :])
    return d - d.mean(axis=0)[None, :] - d.mean(axis=1)[:, None] + d.mean()


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The root of the mean product of doubly centred distances over the root of both mean squares, on dates that both have; quadratic in a pair's dates."""
    both = ~(np.isnan(x) | np.isnan(y))
    if both.sum() < 2:
        return np.nan
    a, b = _centred_distances(x[both]), _centred_distances(y[both])
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float(np.sqrt(max(0.0, (a * b).sum()) / scale)) if scale else np.nan


def distance_correlation_distance(series: DataFrame) -> DataFrame:
    """sqrt(1 - distance correlation) of every two assets."""
    found = tiled(series, lambda x, y: np.array([[distance_correlation(p, q) for q in y] for p in x]))
    return found.withColumn("v", F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("v")))))


def gerber(series: DataFrame, threshold: float = 0.5, psd: bool = True) -> DataFrame:
    """Co-movements beyond ``threshold`` deviations: concordant less discordant, over all but the doubly neutral, scaled to a covariance."""
    sd = F.stddev_pop("r").over(by_asset())
    s = series.withColumn("sd", sd).withColumn("up", (F.col("r") >= threshold * F.col("sd")).cast("int")).withColumn("down", (F.col("r") <= -threshold * F.col("sd")).cast("int"))
    same = F.col("up_i") * F.col("up_j") + F.col("down_i") * F.col("down_j")
    apart = F.col("up_i") * F.col("down_j") + F.col("down_i") * F.col("up_j")
    neutral = (1 - F.col("up_i") - F.col("down_i")) * (1 - F.col("up_j") - F.col("down_j"))
    g = pairs(s, "up", "down", "sd").groupBy("asset_i", "asset_j").agg(F.sum(same - apart).alias("h"), (F.count("*") - F.sum(neutral)).alias("n"), F.first("sd_i").alias("sd_i"), F.first("sd_j").alias("sd_j"))
    if psd:
        return g.select("asset_i", "asset_j", (F.try_divide("h", "n") * F.col("sd_i") * F.col("sd_j")).alias("v"))
    own = g.where("asset_i = asset_j").select(F.col("asset_i").alias("a"), F.sqrt("h").alias("root"))
    g = g.join(own.withColumnRenamed("a", "asset_i").withColumnRenamed("root", "root_i"), "asset_i").join(own.withColumnRenamed("a", "asset_j").withColumnRenamed("root", "root_j"), "asset_j")
    return g.select("asset_i", "asset_j", (F.try_divide(F.col("h"), F.col("root_i") * F.col("root_j")) * F.col("sd_i") * F.col("sd_j")).alias("v"))


def decay(half_life: float) -> float:
    return 2.0 ** (-1.0 / half_life)


def _age(keys: list[str]) -> Column:
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t"))) - 1).cast("double")


def ew_mean(series: DataFrame, half_life: float) -> DataFrame:
    """Exponentially weighted mean per asset in closed form: a weight by age for each observation, corrected for the missing past."""
    lam = decay(half_life)
    s = series.withColumn("w", (1 - lam) * F.pow(F.lit(lam), _age(["asset"])))
    return s.groupBy("asset").agg((F.sum(F.col("w") * F.col("r")) / (1 - F.pow(F.lit(lam), F.count("*").cast("double")))).alias("mean"))


def ew_variance(series: DataFrame, half_life: float) -> DataFrame:
    """The same of squared returns."""
    return ew_mean(series.withColumn("r", F.col("r") * F.col("r")), half_life).withColumnRenamed("mean", "variance")


def ew_covariance(series: DataFrame, half_life: float) -> DataFrame:
    """Per pair over dates that have both, corrected by each asset's own number of observations."""
    lam = decay(half_life)

    def compute(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        known_x, known_y = ~np.isnan(x), ~np.isnan(y)
        fx, fy = np.nan_to_num(x), np.nan_to_num(y)
        root = lambda known: np.sqrt(1 - lam ** known.sum(axis=1))
        out = np.empty((len(x), len(y)))
        for k in range(len(x)):
            both = known_x[k] & known_y
            age = np.cumsum(both[:, ::-1], axis=1)[:, ::-1] - 1  # dates of both that came later
            out[k] = np.where(both, (1 - lam) * lam**age * fx[k] * fy, 0.0).sum(axis=1)
        return out / np.outer(root(known_x), root(known_y))

    return tiled(series, compute)


def shrunk_covariance(series: DataFrame, method: str = "ledoit_wolf", share: float = 0.1) -> DataFrame:
    """The biased covariance drawn towards its mean variance times the identity, by the share of Ledoit and Wolf, of the oracle approximation, or a ``fixed`` one.

    Every asset needs every date. The share follows from sums: of the matrix's squares, its trace, and the squared
    squared norms of the dates.
    """
    centred = series.withColumn("x", F.col("r") - F.avg("r").over(by_asset()))
    s = pairs(centred, "x").groupBy("asset_i", "asset_j").agg(F.avg(F.col("x_i") * F.col("x_j")).alias("v"))
    own = F.col("asset_i") == F.col("asset_j")
    norm = s.agg(F.sum(F.col("v") * F.col("v")).alias("d"), F.sum(F.when(own, F.col("v"))).alias("trace"), F.count_if(own).alias("p")).first()
    d, trace, p = norm["d"], norm["trace"], norm["p"]
    if not p:
        return s
    mu = trace / p
    if method == "ledoit_wolf":
        dates = centred.groupBy("t").agg(F.sum(F.col("x") * F.col("x")).alias("q")).agg(F.count("*").alias("n"), F.sum(F.col("q") * F.col("q")).alias("q")).first()
        beta, delta = (dates["q"] / dates["n"] - d) / (p * dates["n"]), (d - p * mu * mu) / p
        share = min(beta, delta) / delta if min(beta, delta) else 0.0
    elif method == "oracle_approximating":
        n = series.select("t").distinct().count()
        alpha = d / p**2
        below = (n + 1) * (alpha - mu * mu / p)
        share = min((alpha + mu * mu) / below, 1.0) if below else 1.0
    return s.withColumn("v", (1 - share) * F.col("v") + F.when(own, share * mu).otherwise(0.0))


def implied_volatility_forecast(series: DataFrame, vols: DataFrame, window: int = 20, factor: float = 252.0) -> DataFrame:
    """(asset, vol): the next block's volatility from annual implied ones (t, asset, vol).

    Per asset, the logarithm of a block's realised volatility is regressed on those of the block before it and of the implied volatility at
    that block's end. Blocks hold ``window`` dates and end with the panel; an asset needs three.
    """
    vol = F.col("vol") / F.sqrt(F.lit(factor))
    b = blocks(indexed(series.select("t", "asset", "r")), window).join(vols.select("t", "asset", "vol"), ["t", "asset"]).groupBy("asset", "block").agg(F.log(F.stddev_samp("r")).alias("rv"), F.log(F.max_by(vol, "t")).alias("iv"))
    b = b.withColumn("y", F.lead("rv").over(by_asset().orderBy("block")))
    known = F.col("y").isNotNull()
    on = lambda c: F.when(known, F.col(c))
    s = lambda x, y: F.covar_pop(on(x), on(y))
    g = b.groupBy("asset").agg(s("iv", "iv").alias("ii"), s("rv", "rv").alias("rr"), s("iv", "rv").alias("ir"), s("iv", "y").alias("iy"), s("rv", "y").alias("ry"), F.avg(on("iv")).alias("mi"), F.avg(on("rv")).alias("mr"), F.avg("y").alias("my"), F.max_by("iv", "block").alias("i"), F.max_by("rv", "block").alias("r"), F.count("*").alias("n"))
    below = F.col("ii") * F.col("rr") - F.col("ir") * F.col("ir")
    bi = F.try_divide(F.col("iy") * F.col("rr") - F.col("ry") * F.col("ir"), below)
    br = F.try_divide(F.col("ry") * F.col("ii") - F.col("iy") * F.col("ir"), below)
    return g.where("n >= 3").select("asset", F.exp(F.col("my") + bi * (F.col("i") - F.col("mi")) + br * (F.col("r") - F.col("mr"))).alias("vol"))


def with_volatilities(corr: DataFrame, vols: DataFrame) -> DataFrame:
    """The covariance of correlations (asset_i, asset_j, v) and volatilities (asset, vol)."""
    side = lambda s: vols.select(F.col("asset").alias(f"asset_{s}"), F.col("vol").alias(f"vol_{s}"))
    return corr.join(side("i"), "asset_i").join(side("j"), "asset_j").select("asset_i", "asset_j", (F.col("v") * F.col("vol_i") * F.col("vol_j")).alias("v"))


def implied_covariance(series: DataFrame, vols: DataFrame, window: int = 20, factor: float = 252.0, premium: float | None = None) -> DataFrame:
    """Empirical correlations with forecast volatilities; with ``premium``, the last implied ones over it instead."""
    if premium is not None:
        found = vols.groupBy("asset").agg((F.max_by("vol", "t") / F.sqrt(F.lit(factor)) / premium).alias("vol"))
    else:
        found = implied_volatility_forecast(series, vols, window, factor)
    return with_volatilities(correlation(series), found)


def equilibrium_mean(series: DataFrame, risk_aversion: float = 1.0) -> DataFrame:
    """Risk aversion times covariance times equal weights."""
    return covariance(series).groupBy(F.col("asset_i").alias("asset")).agg((risk_aversion * F.avg("v")).alias("mean"))


def inverse_volatility(series: DataFrame) -> DataFrame:
    s = series.groupBy("asset").agg((1 / F.stddev_samp("r")).alias("v"))
    return s.select("asset", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("weight"))
