"""Bivariate copulas as Column expressions: distribution, h-function, log-density, tails; fits by Kendall's tau."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .special import normal_distribution, normal_quantile, student_cdf, student_ppf

#: Pseudo-observations stay this far from 0 and 1.
EDGE = 1e-9

ln, exp, power = F.log, F.exp, F.pow


def _p(x: Column, y) -> Column:
    return power(x, y if isinstance(y, Column) else F.lit(float(y)))


def clayton_theta(tau: float) -> float:
    return min(50.0, max(1e-4, 2 * tau / (1 - tau)))


def gumbel_theta(tau: float) -> float:
    return min(80.0, max(1.0001, 1 / (1 - tau)))


def clayton_cdf(u: Column, v: Column, theta: float) -> Column:
    return _p(_p(u, -theta) + _p(v, -theta) - 1, -1 / theta)


def clayton_h(u: Column, v: Column, theta: float) -> Column:
    """Probability of U up to u given V = v."""
    return _p(1 + _p(v, theta) * (_p(u, -theta) - 1), -(1 + 1 / theta))


def clayton_inverse_h(p: Column, v: Column, theta: float) -> Column:
    return _p(1 + _p(v, -theta) * (_p(p, -theta / (1 + theta)) - 1), -1 / theta)


def clayton_log_density(u: Column, v: Column, theta: float) -> Column:
    return ln(F.lit(1 + theta)) - (1 + theta) * (ln(u) + ln(v)) - (2 + 1 / theta) * ln(_p(u, -theta) + _p(v, -theta) - 1)


def gumbel_cdf(u: Column, v: Column, theta: float) -> Column:
    return exp(-_p(_p(-ln(u), theta) + _p(-ln(v), theta), 1 / theta))


def gumbel_h(u: Column, v: Column, theta: float) -> Column:
    return gumbel_cdf(u, v, theta) * _p(_p(ln(u) / ln(v), theta) + 1, 1 / theta - 1) / v


def joe_cdf(u: Column, v: Column, theta: float) -> Column:
    a, b = _p(1 - u, theta), _p(1 - v, theta)
    return 1 - _p(a + b - a * b, 1 / theta)


def joe_h(u: Column, v: Column, theta: float) -> Column:
    a, b = _p(1 - u, theta), _p(1 - v, theta)
    return _p(1 + a / b - a, 1 / theta - 1) * (1 - a)


def gumbel_log_density(u: Column, v: Column, theta) -> Column:
    x, y = -ln(u), -ln(v)
    s = _p(x, theta) + _p(y, theta)
    root = _p(s, 1 / theta)
    return -root + x + y + (theta - 1) * (ln(x) + ln(y)) + (2 / theta - 2) * ln(s) + ln(1 + (theta - 1) / root)


def joe_log_density(u: Column, v: Column, theta) -> Column:
    a, b = _p(1 - u, theta), _p(1 - v, theta)
    g = a + b - a * b
    return (1 / theta - 2) * ln(g) + (theta - 1) * (ln(1 - u) + ln(1 - v)) + ln(theta - 1 + g)


def gaussian_rho(tau: Column) -> Column:
    """The correlation whose normal copula has this tau, away from 1."""
    return F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.sin(F.pi() / 2 * tau)))


def gaussian_h(u: Column, v: Column, rho) -> Column:
    """Probability of U up to u given V = v."""
    return normal_distribution((normal_quantile(u) - rho * normal_quantile(v)) / _p(F.lit(1.0) - rho * rho, 0.5))


def gaussian_inverse_h(p: Column, v: Column, rho) -> Column:
    return normal_distribution(normal_quantile(p) * _p(F.lit(1.0) - rho * rho, 0.5) + rho * normal_quantile(v))


def gaussian_log_density(x: Column, y: Column, rho) -> Column:
    """Of normal scores x and y: ``normal_quantile`` of u and v, so that several densities share them."""
    rest = F.lit(1.0) - rho * rho
    return -ln(rest) / 2 - (rho * rho * (x * x + y * y) - 2 * rho * x * y) / (2 * rest)


def independent_cdf(u: Column, v: Column) -> Column:
    return u * v


def rotated_cdf(cdf, u: Column, v: Column, degrees: int, *theta: float) -> Column:
    """The copula turned by 90, 180 or 270 degrees."""
    if degrees == 90:
        return v - cdf(1 - u, v, *theta)
    if degrees == 180:
        return u + v - 1 + cdf(1 - u, 1 - v, *theta)
    if degrees == 270:
        return u - cdf(u, 1 - v, *theta)
    return cdf(u, v, *theta)


def rotated_log_density(density, u: Column, v: Column, degrees: int, *theta) -> Column:
    """The density of a copula turned by 90, 180 or 270 degrees, as ``rotated_cdf`` turns it."""
    return density(1 - u if degrees in (90, 180) else u, 1 - v if degrees in (180, 270) else v, *theta)


def _bounded(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


#: Families that are fitted by tau's size and turned by its sign: (theta of |tau|, log-density).
ONE_SIDED = {
    "clayton": (lambda tau: _bounded(2 * tau / (1 - tau), 1e-4, 50.0), clayton_log_density),
    "gumbel": (lambda tau: _bounded(1 / (1 - tau), 1.0001, 80.0), gumbel_log_density),
}


def select_copula(pairs: DataFrame, taus: DataFrame, families: tuple[str, ...] = ("independent", "clayton", "gumbel", "gaussian")) -> DataFrame:
    """(asset_i, asset_j, tau, family, degrees, theta, log_likelihood, aic): for each pair of ``pairs`` (asset_i, asset_j, u, v) the family and turn
    with the least AIC, fitted by Kendall's tau of ``taus`` (asset_i, asset_j, tau).

    One-sided families are turned by 0 or 180 degrees for a positive tau, 90 or 270 for a negative one. All candidates share one aggregation;
    pairs without a tau go.
    """
    keys = ["asset_i", "asset_j"]
    rows = pairs.join(taus.where("tau is not null"), keys)
    size = F.least(F.abs("tau"), F.lit(0.999))
    rising = F.col("tau") >= 0
    if "gaussian" in families:
        rows = rows.withColumn("x", normal_quantile(F.col("u"))).withColumn("y", normal_quantile(F.col("v")))
    candidates, sums = [], []
    for f in families:
        if f == "independent":
            candidates.append((f, F.lit(0), F.lit(None).cast("double"), F.lit(0.0), 0))
        elif f == "gaussian":
            sums.append(F.sum(gaussian_log_density(F.col("x"), F.col("y"), gaussian_rho(F.col("tau")))).alias(f))
            candidates.append((f, F.lit(0), gaussian_rho(F.col("tau")), F.col(f), 1))
        else:
            theta, density = ONE_SIDED[f]
            for k, (up, down) in enumerate(((0, 90), (180, 270))):
                turned = lambda d: rotated_log_density(density, F.col("u"), F.col("v"), d, theta(size))  # noqa: B023, E731
                sums.append(F.sum(F.when(rising, turned(up)).otherwise(turned(down))).alias(f"{f}{k}"))
                candidates.append((f, F.when(rising, up).otherwise(down), theta(size), F.col(f"{f}{k}"), 1))
    found = rows.groupBy(*keys, "tau").agg(F.count("*").alias("n"), *sums)
    each = F.array(*(F.struct((2 * count - 2 * fit).alias("aic"), F.lit(name).alias("family"), degrees.cast("int").alias("degrees"), theta.alias("theta"), fit.alias("log_likelihood")) for name, degrees, theta, fit, count in candidates))
    return found.select(*keys, "tau", F.array_min(each).alias("c")).select(*keys, "tau", "c.family", "c.degrees", "c.theta", "c.log_likelihood", "c.aic")


def fit_normal(series: DataFrame) -> DataFrame:
    """(asset, loc, scale, log_likelihood, aic, bic) of the normal distribution of greatest likelihood for each asset's r."""
    g = series.groupBy("asset").agg(F.avg("r").alias("loc"), F.stddev_pop("r").alias("scale"), F.count("r").alias("n"))
    fit = -F.col("n") / 2 * (F.log(2 * F.pi() * F.col("scale") * F.col("scale")) + 1)
    g = g.withColumn("log_likelihood", fit)
    return g.select("asset", "loc", "scale", "log_likelihood", (4 - 2 * F.col("log_likelihood")).alias("aic"), (2 * F.log(F.col("n")) - 2 * F.col("log_likelihood")).alias("bic"))


def lower_tail_clayton(theta: float) -> float:
    return 2 ** (-1 / theta)


def upper_tail_gumbel(theta: float) -> float:
    return 2 - 2 ** (1 / theta)


def pseudo_observations(series: DataFrame) -> DataFrame:
    """(asset, t, u): average-tie ranks over the count plus one, within the edges."""
    by = Window.partitionBy("asset")
    mid = F.rank().over(by.orderBy("r")) + (F.count("*").over(Window.partitionBy("asset", "r")) - 1) / 2
    u = mid / (F.count("*").over(by) + 1)
    return series.select("asset", "t", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), u)).alias("u"))


def empirical_tail_concentration(pairs: DataFrame, quantiles: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, q, concentration) of pairs (u, v): P(V <= q | U <= q) up to one half, P(V >= q | U >= q) above; 0 without mass."""
    q = F.explode(F.array(*map(F.lit, quantiles)))
    rows = pairs.select(*keys, "u", "v", q.alias("q"))
    in_u = F.when(F.col("q") <= 0.5, F.col("u") <= F.col("q")).otherwise(F.col("u") >= F.col("q"))
    in_v = F.when(F.col("q") <= 0.5, F.col("v") <= F.col("q")).otherwise(F.col("v") >= F.col("q"))
    return rows.groupBy(*keys, "q").agg(F.coalesce(F.try_divide(F.count_if(in_u & in_v), F.count_if(in_u)), F.lit(0.0)).alias("concentration"))


def opinion_pool(experts: DataFrame, shares: dict[str, float], linear: bool = True) -> DataFrame:
    """(obs_idx, p) from experts' scenario weights (expert, obs_idx, p); what shares leave of 1 goes to the uniform."""
    share = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v))))
    rest = 1 - sum(shares.values())
    s = experts.withColumn("s", F.coalesce(share[F.col("expert")], F.lit(0.0)))
    n = F.count("*").over(Window.partitionBy())
    if linear:
        g = s.groupBy("obs_idx").agg(F.sum(F.col("s") * F.col("p")).alias("x"))
        return g.select("obs_idx", (F.col("x") + rest / n).alias("p"))
    g = s.groupBy("obs_idx").agg(F.sum(F.col("s") * F.log("p")).alias("x")).withColumn("x", F.exp(F.col("x") + rest * F.log(1 / n)))
    return g.select("obs_idx", (F.col("x") / F.sum("x").over(Window.partitionBy())).alias("p"))


def mutual_information(pairs: DataFrame, bins: int) -> DataFrame:
    """(asset_i, asset_j, v): mutual information of (r_i, r_j) over equal-width bins, as the share of the smaller entropy that is missing."""
    by = Window.partitionBy("asset_i", "asset_j")
    place = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.min(c).over(by)) / ((F.max(c).over(by) - F.min(c).over(by)) / bins)))
    cells = pairs.withColumn("a", place("r_i")).withColumn("b", place("r_j")).groupBy("asset_i", "asset_j", "a", "b").agg(F.count("*").alias("c"))
    total = F.sum("c").over(by)
    cells = cells.withColumn("p", F.col("c") / total).withColumn("pa", F.sum("c").over(Window.partitionBy("asset_i", "asset_j", "a")) / total).withColumn("pb", F.sum("c").over(Window.partitionBy("asset_i", "asset_j", "b")) / total)
    g = cells.groupBy("asset_i", "asset_j").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), (-F.sum(F.col("p") * F.log("pa"))).alias("ha"), (-F.sum(F.col("p") * F.log("pb"))).alias("hb"))
    return g.select("asset_i", "asset_j", (1 - F.try_divide("mi", F.least("ha", "hb"))).alias("v"))


def sample(spark: SparkSession, n: int, inverse_h, *theta, seed: int = 0) -> DataFrame:
    """(id, u, v): ``n`` draws of the copula with this inverse h-function. Uniforms are hashes of seed and id, so reruns and retried tasks agree."""
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = spark.range(n).select("id", uniform("p").alias("p"), uniform("v").alias("v"))
    return drawn.select("id", inverse_h(F.col("p"), F.col("v"), *theta).alias("u"), "v")


#: Degrees of freedom of Student's copula are sought within these bounds.
FREEDOM = (2.0, 50.0)


def student_log_density(x: np.ndarray, y: np.ndarray, rho: float, freedom: float) -> np.ndarray:
    """Of t scores x and y, the quantiles of u and v."""
    k = freedom
    level = math.lgamma((k + 2) / 2) + math.lgamma(k / 2) - 2 * math.lgamma((k + 1) / 2) - 0.5 * math.log(1 - rho * rho)
    both = np.log1p((x * x + y * y - 2 * rho * x * y) / (k * (1 - rho * rho)))
    return level - (k + 2) / 2 * both + (k + 1) / 2 * (np.log1p(x * x / k) + np.log1p(y * y / k))


def student_h(u: Column, v: Column, rho: float, freedom: float) -> Column:
    """Probability of U up to u given V = v, in Arrow batches."""

    @F.pandas_udf("double")
    def conditional(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = student_ppf(a.to_numpy(float), freedom), student_ppf(b.to_numpy(float), freedom)
        return pd.Series(student_cdf((x - rho * y) / np.sqrt((1 - rho * rho) * (freedom + y * y) / (freedom + 1)), freedom + 1))

    return conditional(u, v)


@lru_cache(maxsize=512)
def _scores(values: bytes, freedom: float) -> np.ndarray:
    """Quantiles of t at many shares. Ranks give all pairs the same shares, and the search below the same first degrees of freedom."""
    return student_ppf(np.frombuffer(values), freedom)


def fit_student(pairs: DataFrame, taus: DataFrame, rounds: int = 16) -> DataFrame:
    """(asset_i, asset_j, tau, rho, freedom, log_likelihood, aic): the correlation from Kendall's tau, then the degrees of freedom of greatest likelihood
    by golden section on their logarithm. Each pair's dates are one task's.
    """
    g = (math.sqrt(5) - 1) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, tau = pdf["u"].to_numpy(float), pdf["v"].to_numpy(float), float(pdf["tau"].iloc[0])
        rho = min(0.999, max(-0.999, math.sin(math.pi / 2 * tau)))
        values, at = np.unique(np.concatenate([u, v]), return_inverse=True)

        def fit(log_k: float) -> float:
            k = math.exp(log_k)
            scores = _scores(values.tobytes(), k)[at]
            return float(student_log_density(scores[: len(u)], scores[len(u) :], rho, k).sum())

        low, high = map(math.log, FREEDOM)
        a, b = high - g * (high - low), low + g * (high - low)
        fa, fb = fit(a), fit(b)
        for _ in range(rounds):
            if fa >= fb:
                high, b, fb = b, a, fa
                a = high - g * (high - low)
                fa = fit(a)
            else:
                low, a, fa = a, b, fb
                b = low + g * (high - low)
                fb = fit(b)
        best = max(((fit(k), k) for k in ((low + high) / 2, *map(math.log, FREEDOM))))
        return pd.DataFrame({"asset_i": pdf["asset_i"].iloc[:1], "asset_j": pdf["asset_j"].iloc[:1], "tau": tau, "rho": rho, "freedom": math.exp(best[1]), "log_likelihood": best[0], "aic": 4 - 2 * best[0]})

    rows = pairs.select("asset_i", "asset_j", "u", "v").join(taus.where("tau is not null"), ["asset_i", "asset_j"])
    # Small rows, long work: the given number of partitions holds, where AQE would merge them.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "asset_i", "asset_j")
    return rows.groupBy("asset_i", "asset_j").applyInPandas(run, "asset_i string, asset_j string, tau double, rho double, freedom double, log_likelihood double, aic double")
