"""Queries of shrunk covariances, selections, allocators and their evaluation, with the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import cross_section as cs
from .operators import entropic as en
from .operators import forecasts as fo
from .operators import matrices as mx
from .operators import measures as ms
from .operators import panel as pn
from .operators import portfolios as pf
from .operators import selection as se
from .operators import spectra
from .functions import copulas as cp
from .plans import allocation as al
from .plans import distributions as di
from .plans import priors as pr
from .plans import risk
from .plans import splits as sp
from .plans import uncertainty as un
from .queries import BRANDS, DAILY, DAY, OOS, POPULATION, POPULATION_FRAME, PAIRED, PAIRS, PSEUDO, RETURNS, ROLL, _months, monthly_returns, paired, population, population_weights, q8, register, uv
from .sources import panels
from .storage import cut
from .streaming import exponential as ew

# Shrunk covariances -------------------------------------------------------------------------------

_S = RETURNS + """,
ce AS (SELECT t, asset, r - avg(r) OVER (PARTITION BY asset) AS x FROM ret),
s AS (SELECT a.asset AS asset_i, b.asset AS asset_j, avg(a.x * b.x) AS v FROM ce a JOIN ce b USING (t) GROUP BY 1, 2),
nm AS (SELECT sum(v * v) AS d, sum(CASE WHEN asset_i = asset_j THEN v END) / sum(CASE WHEN asset_i = asset_j THEN 1 ELSE 0 END) AS mu,
              CAST(sum(CASE WHEN asset_i = asset_j THEN 1 ELSE 0 END) AS DOUBLE) AS p FROM s),
dt AS (SELECT count(*) AS n, sum(q * q) AS q FROM (SELECT t, sum(x * x) AS q FROM ce GROUP BY t))"""
_SHARES = {
    "ledoit_wolf": "(SELECT least((q / n - d) / (p * n), (d - p * mu * mu) / p) / ((d - p * mu * mu) / p) FROM nm, dt)",
    "oracle_approximating": "(SELECT least(1, (d / p ** 2 + mu * mu) / ((n + 1) * (d / p ** 2 - mu * mu / p))) FROM nm, dt)",
    "fixed": "0.1::DOUBLE",
}
for _method, _share in _SHARES.items():
    register(
        f"cov_shrunk_{_method}",
        f"WITH {_S}, sh AS (SELECT {_share} AS share) SELECT asset_i, asset_j, {q8('(1 - share) * v + CASE WHEN asset_i = asset_j THEN share * mu ELSE 0 END')} AS v FROM s, nm, sh",
        lambda s, d, m=_method: mx.shrunk_covariance(monthly_returns(s, d), m),
    )

# Selection ----------------------------------------------------------------------------------------

_RATIO = f"WITH {RETURNS}, m AS (SELECT asset, avg(r) AS mean, stddev_samp(r) AS sd, var_samp(r) AS variance FROM ret GROUP BY asset)"
register(
    "sel_k_extremes_ratio",
    f"{_RATIO} SELECT asset FROM m ORDER BY mean / sd DESC, asset LIMIT 5",
    lambda s, d: se.keep_extremes(monthly_returns(s, d), "sharpe_ratio", 5),
)
register(
    "sel_non_dominated",
    f"{_RATIO} SELECT asset FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.mean >= a.mean AND b.variance <= a.variance AND (b.mean > a.mean OR b.variance < a.variance))",
    lambda s, d: se.keep_undominated(monthly_returns(s, d), ["mean"], ["variance"]),
)

# Allocation: what makes weights optimal, checked on what the engine returns -----------------------------


def allocated(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Weights (portfolio_id, asset, weight) of allocators, each solved in a task of its own."""
    each = F.explode(F.array(*map(F.lit, names))).alias("allocator")
    found = risk.allocate(monthly_returns(spark, d).select("t", "asset", "r", each), [])
    return found.select(F.col("allocator").alias("portfolio_id"), "asset", "weight")


def marginal(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(asset, weight, own: the asset's covariance with the portfolio, whole: the portfolio's variance)."""
    w = allocated(spark, d, [name])
    cov = mx.covariance(monthly_returns(spark, d))
    own = cov.join(w.select(F.col("asset").alias("asset_j"), F.col("weight").alias("held")), "asset_j").groupBy(F.col("asset_i").alias("asset")).agg(F.sum(F.col("v") * F.col("held")).alias("own"))
    both = w.join(own, "asset")
    whole = both.agg(F.sum(F.col("weight") * F.col("own"))).first()[0] or 0.0
    return both.select("asset", "weight", "own", F.lit(float(whole)).alias("whole"))


#: Allocators take the assets with a return on every date.
_WHOLE = f"WITH {RETURNS}, a AS (SELECT asset FROM ret GROUP BY asset HAVING count(*) = (SELECT count(DISTINCT t) FROM ret))"
register(
    "risk_parity_shares",
    f"{_WHOLE} SELECT asset, round(1.0::DOUBLE / count(*) OVER (), 4) + 0.0 AS share FROM a",
    lambda s, d: marginal(s, d, "risk_parity").select("asset", F.round(F.col("weight") * F.col("own") / F.col("whole"), 4).alias("share")),
)
register(
    # Weights are least in variance if no asset's covariance with the portfolio is below its variance, and those held are at it.
    "min_variance_optimality",
    f"{_WHOLE} SELECT asset, true AS feasible, true AS stationary, true AS complementary FROM a",
    lambda s, d: marginal(s, d, "least_variance").select(
        "asset",
        (F.col("weight") >= -1e-9).alias("feasible"),
        (F.col("own") >= F.col("whole") * (1 - 1e-4)).alias("stationary"),
        (F.col("weight") * (F.col("own") - F.col("whole")) <= 1e-4 * F.col("whole")).alias("complementary"),
    ),
)


def least_risks(spark: SparkSession, d: str) -> DataFrame:
    """For every risk, whether its portfolio is fully invested and no riskier than equal weights and every single asset."""
    names = [f"least_{r}" for r in risk.RISKS]
    series = monthly_returns(spark, d)
    found = allocated(spark, d, names)
    taken = found.select("asset").distinct()
    single = taken.select(F.concat(F.lit("only "), "asset").alias("portfolio_id"), "asset", F.lit(1.0).alias("weight"))
    every = found.unionByName(single).unionByName(pf.equal_weights(taken))
    values = ms.measure(pf.portfolio_returns(series, every), risk.RISKS, ["portfolio_id"])
    mine = F.col("portfolio_id").startswith("least_")
    best = values.agg(*(((F.max(F.when(F.col("portfolio_id") == f"least_{r}", F.col(r)))) <= F.min(F.when(~mine, F.col(r))) + 1e-7).alias(r) for r in risk.RISKS))
    best = best.unpivot([], list(risk.RISKS), "risk", "best")
    budget = found.groupBy("portfolio_id").agg((F.abs(F.sum("weight") - 1) < 1e-6).alias("invested")).select(F.expr("substring(portfolio_id, 7)").alias("risk"), "invested")
    return best.join(budget, "risk")


register("least_risk_optimality", f"SELECT unnest({list(risk.RISKS)!r}) AS risk, true AS best, true AS invested", least_risks)


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample returns of two allocators over all splits by the general path."""
    series = pn.indexed(monthly_returns(spark, d))
    rows = sp.assign(series.select("t", "obs_idx").distinct(), sp.table(spark, sp.walk_forward(_months(spark, d), 6, 24, 1)))
    part = lambda role: rows.where(F.col("role") == role).select("split_id", "t")
    return risk.out_of_sample(series.select("t", "asset", "r"), part("train"), part("test"), ["equal", "inverse_volatility"])


register(
    "wf_oos_allocators",
    f"""WITH {OOS}, k AS (SELECT split_id, asset, stddev_samp(r) AS sd FROM ix JOIN sp ON role = 'train' AND i >= lo AND i < hi GROUP BY 1, 2, hi, lo HAVING count(*) = hi - lo),
    m AS (SELECT split_id, asset, 'inverse_volatility' AS allocator, (1 / sd) / sum(1 / sd) OVER (PARTITION BY split_id) AS weight FROM k
          UNION ALL SELECT split_id, asset, 'equal', 1.0::DOUBLE / count(*) OVER (PARTITION BY split_id) FROM k)
    SELECT split_id, allocator, {DAY}, {q8('sum(weight * r)')} AS r FROM ix JOIN sp ON role = 'test' AND i >= lo AND i < hi JOIN m USING (split_id, asset) GROUP BY split_id, allocator, ix.t""",
    evaluated,
)


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Weights by recursive bisection of a Ward tree."""
    return allocated(spark, d, ["hierarchical_risk_parity"]).select("asset", "weight")


register("hrp_budget", "SELECT 1.0 + 0.0 AS invested, true AS positive", lambda s, d: hierarchy(s, d).agg(F.round(F.sum("weight"), 6).alias("invested"), (F.min("weight") > 0).alias("positive")))

# Entropic risks: the same narrowing grid in SQL ----------------------------------------------------------


def _entropic_sql(losses: str, name: str) -> str:
    """One CTE per round; ``losses`` is a SELECT of (asset, loss)."""
    grid = f"low + (high - low) * k / {en.POINTS - 1}.0::DOUBLE"
    out = f"WITH {RETURNS}, lo AS ({losses}), g0 AS (SELECT asset, max(loss) AS top, ln(greatest(max(abs(loss)), 1e-12) / 100) AS low, ln(greatest(max(abs(loss)), 1e-12) * 1000) AS high FROM lo GROUP BY asset)"
    for i in range(en.ROUNDS):
        out += f""",
    p{i} AS (SELECT asset, top, low, high, k, exp({grid}) AS z FROM g{i}, range({en.POINTS}) AS u(k)),
    f{i} AS (SELECT p.asset, top, low, high, k, top + z * ln(avg(exp((loss - top) / z)) / (1 - 0.95::DOUBLE)) AS value FROM p{i} p JOIN lo ON lo.asset = p.asset GROUP BY p.asset, top, low, high, k, z),
    b{i} AS (SELECT asset, top, any_value(low) AS low, any_value(high) AS high, min(value) AS value, arg_min(k, value) AS k FROM f{i} GROUP BY asset, top),
    g{i + 1} AS MATERIALIZED (SELECT asset, top, low + (high - low) / {en.POINTS - 1} * greatest(k - 1, 0) AS low, low + (high - low) / {en.POINTS - 1} * least(k + 1, {en.POINTS - 1}) AS high, value FROM b{i})"""
    return out + f" SELECT asset, round(value, 6) + 0.0 AS {name} FROM g{en.ROUNDS}"


_FALLS = """SELECT asset, max(cum) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) - cum AS loss
    FROM (SELECT asset, t, sum(r) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum FROM ret)"""
register("m_evar", _entropic_sql("SELECT asset, -r AS loss FROM ret", "evar"), lambda s, d: en.evar(monthly_returns(s, d)).withColumn("evar", F.round("evar", 6)))
register("m_edar", _entropic_sql(_FALLS, "edar"), lambda s, d: en.edar(monthly_returns(s, d)).withColumn("edar", F.round("edar", 6)))

# Distances ----------------------------------------------------------------------------------------

register(
    "dist_covariance",
    f"WITH {_S}, sd AS (SELECT asset_i AS asset, sqrt(v) AS sd FROM s WHERE asset_i = asset_j) SELECT asset_i, asset_j, {q8('sqrt(greatest(0, least(1, 0.5 * (1 - v / (a.sd * b.sd)))))')} AS v FROM s JOIN sd a ON a.asset = asset_i JOIN sd b ON b.asset = asset_j WHERE asset_i <> asset_j",
    lambda s, d: mx.covariance_distance(mx.shrunk_covariance(monthly_returns(s, d), "fixed", 0.0)).where("asset_i <> asset_j"),
)
register(
    "dist_distance_correlation",
    f"""WITH {RETURNS}, w AS (SELECT asset, t, r FROM ret WHERE asset IN (SELECT asset FROM ret GROUP BY asset HAVING count(*) = (SELECT count(DISTINCT t) FROM ret))),
    d AS (SELECT a.asset, a.t AS t, b.t AS u, abs(a.r - b.r) AS d FROM w a JOIN w b ON a.asset = b.asset),
    c AS (SELECT asset, t, u, d - avg(d) OVER (PARTITION BY asset, t) - avg(d) OVER (PARTITION BY asset, u) + avg(d) OVER (PARTITION BY asset) AS x FROM d),
    sq AS (SELECT asset, sum(x * x) AS s FROM c GROUP BY asset),
    pr AS (SELECT a.asset AS asset_i, b.asset AS asset_j, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.t = b.t AND a.u = b.u WHERE a.asset < b.asset GROUP BY 1, 2)
    SELECT asset_i, asset_j, {q8('sqrt(greatest(0, least(1, 1 - sqrt(greatest(0, pr.s) / sqrt(x.s * y.s)))))')} AS v FROM pr JOIN sq x ON x.asset = asset_i JOIN sq y ON y.asset = asset_j""",
    lambda s, d: mx.distance_correlation_distance(whole(monthly_returns(s, d))).where("asset_i < asset_j"),
)


def whole(series: DataFrame) -> DataFrame:
    """The series of assets with a return on every date."""
    dates = series.select("t").distinct().count()
    return series.join(series.groupBy("asset").agg(F.count("r").alias("n")).where(F.col("n") == dates).select("asset"), "asset")


# Windows, forecasts, priors -------------------------------------------------------------------------

register(
    "block_volatility",
    f"""WITH {RETURNS}, ix AS (SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS i FROM ret), o AS (SELECT (max(i) + 1) % 12 AS o FROM ix)
    SELECT asset, (i - o) // 12 AS block, {q8('stddev_samp(r)')} AS volatility FROM ix, o WHERE i >= o GROUP BY 1, 2""",
    lambda s, d: pn.block_volatility(monthly_returns(s, d), 12),
)


def covariance_forecasts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(forecast, realised): the sample covariance of every training window, the returns of the test window after it."""
    rows = sp.assign(pn.indexed(monthly_returns(spark, d)), sp.table(spark, sp.walk_forward(_months(spark, d), 6, 24, 1)))
    part = lambda role: rows.where(F.col("role") == role).select("split_id", "t", "asset", "r")
    side = lambda s: part("train").select("split_id", "t", F.col("asset").alias(f"asset_{s}"), F.col("r").alias(f"r_{s}"))
    cov = side("i").join(side("j"), ["split_id", "t"]).groupBy("split_id", "asset_i", "asset_j").agg(F.covar_samp("r_i", "r_j").alias("v"))
    return cov, part("test")


_FC = f"""WITH {OOS}, te AS (SELECT split_id, t, asset, r FROM ix JOIN sp ON role = 'test' AND i >= lo AND i < hi), tn AS (SELECT split_id, t, asset, r FROM ix JOIN sp ON role = 'train' AND i >= lo AND i < hi),
cv AS (SELECT split_id, a.asset AS asset_i, b.asset AS asset_j, covar_samp(a.r, b.r) AS v FROM tn a JOIN tn b USING (split_id, t) GROUP BY 1, 2, 3)"""
register(
    "diagonal_calibration",
    f"""{_FC}, su AS (SELECT split_id, asset, sum(r) AS total, count(r) AS n FROM te GROUP BY 1, 2), q AS (SELECT split_id, avg(total * total / (n * greatest(v, 1e-12))) AS x FROM su JOIN cv USING (split_id) WHERE asset_i = asset AND asset_j = asset GROUP BY 1)
    SELECT split_id, {q8('x')} AS diagonal_ratio, {q8('abs(x - 1)')} AS diagonal_loss FROM q""",
    lambda s, d: fo.diagonal_calibration(*covariance_forecasts(s, d), ["split_id"]),
)
register(
    "portfolio_calibration",
    f"""{_FC}, iv AS (SELECT split_id, asset_i AS asset, (1 / sqrt(greatest(v, 1e-12))) / sum(1 / sqrt(greatest(v, 1e-12))) OVER (PARTITION BY split_id) AS w FROM cv WHERE asset_i = asset_j),
    nn AS (SELECT split_id, a.asset AS asset_i, b.asset AS asset_j, count(*) AS n FROM te a JOIN te b USING (split_id, t) GROUP BY 1, 2, 3),
    e AS (SELECT cv.split_id, greatest(sum(a.w * b.w * n * v), 1e-12) AS e FROM cv JOIN nn USING (split_id, asset_i, asset_j) JOIN iv a ON a.split_id = cv.split_id AND a.asset = asset_i JOIN iv b ON b.split_id = cv.split_id AND b.asset = asset_j GROUP BY 1),
    g AS (SELECT split_id, sum(x * x) AS g FROM (SELECT te.split_id, te.t, sum(w * r) AS x FROM te JOIN iv ON iv.split_id = te.split_id AND iv.asset = te.asset GROUP BY 1, 2) GROUP BY 1)
    SELECT split_id, {q8('g / e')} AS portfolio_ratio, {q8('abs(g / e - 1)')} AS portfolio_loss, {q8('ln(e) + g / e')} AS portfolio_qlike FROM g JOIN e USING (split_id)""",
    lambda s, d: fo.portfolio_calibration(*covariance_forecasts(s, d), ["split_id"]),
)
register("mahalanobis_calibration", None, lambda s, d: fo.mahalanobis_calibration(*covariance_forecasts(s, d), ["split_id"]))


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """The mean and second moment of the equal-weighted portfolio under probabilities that views on both ask for."""
    r = monthly_returns(spark, d).groupBy("t").agg(F.avg("r").alias("x")).withColumn("x2", F.col("x") * F.col("x"))
    base = r.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.avg("x2").alias("m2"), F.count("*").alias("n")).first()
    posterior = pr.entropy_pooling(r.withColumn("p", F.lit(1.0 / base["n"])), [("x", base["m"] + 0.1 * base["sd"]), ("x2", base["m2"])])
    return posterior.agg(F.sum("q").alias("mass"), F.sum(F.col("q") * F.col("x")).alias("mean"), F.sum(F.col("q") * F.col("x2")).alias("second"))


register(
    "entropy_pooling_views",
    f"WITH {RETURNS}, e AS (SELECT t, avg(r) AS x FROM ret GROUP BY t) SELECT 1.0::DOUBLE AS mass, {q8('avg(x) + 0.1 * stddev_pop(x)')} AS mean, {q8('avg(x * x)')} AS second FROM e",
    pooled,
)


def market_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Loadings on the mean return of all brands, with the mean and variance that they imply for each asset."""
    brand = pn.linear_returns(panels.brands(spark, d)).groupBy("t").agg(F.avg("r").alias("f")).withColumn("factor", F.lit("market"))
    assets, _, b, alpha, residual = pr.factor_loadings(monthly_returns(spark, d), brand.select("t", "factor", "f"), intercept=True)
    m = brand.agg(F.avg("f").alias("m"), F.var_samp("f").alias("v")).first()
    mean, cov = pr.factor_model(b, alpha, residual, np.array([m["m"]]), np.array([[m["v"]]]))
    return spark.createDataFrame([(a, float(x), float(u), float(cov[i, i])) for i, (a, x, u) in enumerate(zip(assets, b[:, 0], mean, strict=True))], "asset string, loading double, mean double, variance double")


register(
    "factor_model_market",
    f"""WITH {RETURNS}, {BRANDS}, br AS (SELECT t, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY t) - 1 AS r FROM bx), fa AS (SELECT t, avg(r) AS f FROM br WHERE r IS NOT NULL GROUP BY t),
    mm AS (SELECT avg(f) AS m, var_samp(f) AS v FROM fa), re AS (SELECT asset, regr_slope(r, f) AS b, regr_intercept(r, f) AS a, (regr_syy(r, f) - regr_sxy(r, f) ** 2 / regr_sxx(r, f)) / (count(*) - 1) AS e FROM ret JOIN fa USING (t) GROUP BY asset)
    SELECT asset, {q8('b')} AS loading, {q8('a + b * m')} AS mean, {q8('b * b * v + e')} AS variance FROM re, mm""",
    market_loadings,
)

# Clusters, spectra -----------------------------------------------------------------------------------


def cluster_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Whether the weights of both allocators over clusters are whole and of one sign."""
    w = allocated(spark, d, ["hierarchical_equal_risk", "nested_clusters"])
    return w.groupBy("portfolio_id").agg(F.count("*").alias("assets"), F.round(F.sum("weight"), 6).alias("invested"), (F.min("weight") > -1e-9).alias("positive"))


register("herc_weights", None, lambda s, d: allocated(s, d, ["hierarchical_equal_risk"]).select("asset", "weight"))
register("nested_clusters_weights", None, lambda s, d: allocated(s, d, ["nested_clusters"]).select("asset", "weight"))
register(
    "cluster_budgets",
    f"{_WHOLE} SELECT p AS portfolio_id, count(*) AS assets, 1.0::DOUBLE AS invested, true AS positive FROM a, (SELECT unnest(['hierarchical_equal_risk', 'nested_clusters']) AS p) GROUP BY p",
    cluster_budgets,
)


def cleaned(spark: SparkSession, d: str, method: str) -> DataFrame:
    """(asset_i, asset_j, v) of the covariance without noise or without its market."""
    series = monthly_returns(spark, d)
    assets, _, cov = al.collected(series)
    if not assets:
        return spark.createDataFrame([], "asset_i string, asset_j string, v double")
    v = spectra.denoised(cov, series.select("t").distinct().count()) if method == "denoised" else spectra.detoned(cov)
    return spark.createDataFrame([(a, b, float(v[i, j])) for i, a in enumerate(assets) for j, b in enumerate(assets)], "asset_i string, asset_j string, v double")


register("cov_denoised", None, lambda s, d: cleaned(s, d, "denoised"))
register("cov_detoned", None, lambda s, d: cleaned(s, d, "detoned"))
register(
    "cov_cleaned_variances",
    f"WITH {RETURNS} SELECT method, asset, {q8('var_samp(r)')} AS variance FROM ret, (SELECT unnest(['denoised', 'detoned']) AS method) GROUP BY 1, 2",
    lambda s, d: cleaned(s, d, "denoised").withColumn("method", F.lit("denoised")).unionByName(cleaned(s, d, "detoned").withColumn("method", F.lit("detoned"))).where("asset_i = asset_j").select("method", F.col("asset_i").alias("asset"), F.col("v").alias("variance")),
)

# Calendar and randomized splits, bootstrap ---------------------------------------------------------------


def days(spark: SparkSession, d: str) -> DataFrame:
    """(t, obs_idx) of the daily panel."""
    return pn.indexed(panels.daily(spark, d).select("t").distinct())


_DAYS = f"""WITH {DAILY}, d AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM px)), ends AS (SELECT CAST(min(t) AS TIMESTAMP) AS a, CAST(max(t) AS TIMESTAMP) AS z, count(*) AS n FROM d)"""
register(
    "wf_calendar_splits",
    f"""{_DAYS}, b AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS k FROM (SELECT unnest(generate_series(date_trunc('quarter', a), z, INTERVAL 3 MONTH)) AS b, a FROM ends) WHERE b >= a),
    x AS (SELECT k, min(i) AS idx FROM b JOIN d ON t >= b GROUP BY k),
    w AS (SELECT k, idx, lead(idx, 4) OVER (ORDER BY k) AS s, lead(idx, 5) OVER (ORDER BY k) AS e FROM x)
    SELECT CAST(k AS INTEGER) AS split_id, 'train' AS role, CAST(idx AS BIGINT) AS lo, CAST(s - 2 AS BIGINT) AS hi FROM w WHERE e IS NOT NULL UNION ALL SELECT CAST(k AS INTEGER), 'test', s, e FROM w WHERE e IS NOT NULL""",
    lambda s, d: sp.calendar_walk_forward(days(s, d), 1, 4, "quarter", purge=2),
)
register(
    "wf_calendar_lookback_splits",
    f"""{_DAYS}, b AS (SELECT b + INTERVAL 4 DAY AS b FROM (SELECT unnest(generate_series(date_trunc('month', a - INTERVAL 4 DAY), z, INTERVAL 1 MONTH)) AS b, a FROM ends) WHERE b >= a - INTERVAL 4 DAY),
    x AS (SELECT b, (SELECT max(i) FROM d WHERE t <= b) AS idx, (SELECT max(i) FROM d WHERE t <= b - INTERVAL 200 DAY) AS low FROM b WHERE b <= (SELECT z FROM ends)),
    w AS (SELECT row_number() OVER (ORDER BY b) - 1 AS k, idx, low, lead(idx, 2) OVER (ORDER BY b) - 3 AS e FROM x WHERE idx IS NOT NULL AND low IS NOT NULL)
    SELECT CAST(k // 2 AS INTEGER) AS split_id, 'train' AS role, CAST(low AS BIGINT) AS lo, CAST(idx AS BIGINT) AS hi FROM w WHERE k % 2 = 0 UNION ALL SELECT CAST(k // 2 AS INTEGER), 'test', idx, coalesce(e, n) FROM w, ends WHERE k % 2 = 0""",
    lambda s, d: sp.calendar_walk_forward(days(s, d), 2, "200 DAYS", "month", offset="4 DAYS", previous=True, purge=3, reduce_test=True),
)


def randomized(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample returns of inverse-volatility portfolios over random subsets of assets and random runs of dates."""
    series = pn.indexed(monthly_returns(spark, d))
    assets = sorted(r["asset"] for r in series.select("asset").distinct().collect())
    ranges, of, members = sp.multiple_randomized(_months(spark, d), assets, 8, 5, 6, 24, 1, 48)
    held = spark.createDataFrame(of, "split_id int, path_id int").join(spark.createDataFrame(members, "path_id int, asset string"), "path_id")
    rows = sp.assign(series, sp.table(spark, ranges)).join(held, ["split_id", "asset"])
    vol = rows.where("role = 'train'").groupBy("split_id", "asset").agg((1 / F.stddev_samp("r")).alias("v"))
    return rows.where("role = 'test'").join(vol, ["split_id", "asset"]).groupBy("path_id", "split_id", "t").agg(F.try_divide(F.sum(F.col("v") * F.col("r")), F.sum("v")).alias("r"))


register("mrcv_oos_inverse_volatility", None, randomized)
register(
    "mrcv_shape",
    "SELECT CAST(p AS INTEGER) AS path_id, 5 AS assets, 3 AS splits, 24 AS train, 6 AS test FROM range(8) AS u(p)",
    lambda s, d: mrcv_shape(s, d),
)


def mrcv_shape(spark: SparkSession, d: str) -> DataFrame:
    assets = sorted(r["asset"] for r in monthly_returns(spark, d).select("asset").distinct().collect())
    ranges, of, members = sp.multiple_randomized(_months(spark, d), assets, 8, 5, 6, 24, 1, 48)
    size = lambda role: F.max(F.when(F.col("role") == role, F.col("hi") - F.col("lo"))).cast("int").alias(role)
    each = sp.table(spark, ranges).join(spark.createDataFrame(of, "split_id int, path_id int"), "split_id").groupBy("path_id").agg(F.countDistinct("split_id").cast("int").alias("splits"), size("train"), size("test"))
    return each.join(spark.createDataFrame(members, "path_id int, asset string").groupBy("path_id").agg(F.countDistinct("asset").cast("int").alias("assets")), "path_id")


register(
    "bootstrap_stationary",
    f"WITH {RETURNS} SELECT CAST(k AS INTEGER) AS sample_id, count(DISTINCT t) AS places, true AS known FROM ret, range(20) AS u(k) GROUP BY k",
    lambda s, d: resampled(s, d),
)


def resampled(spark: SparkSession, d: str) -> DataFrame:
    """Whether resamples hold the panel's own returns. Those are written once, as a second reading may add prices in another order and end in other last bits."""
    series = cut(monthly_returns(spark, d), "returns")
    own = series.select("t", "asset", F.col("r").alias("own"))
    known = F.every(F.coalesce(F.col("own") == F.col("r"), F.lit(False))).alias("known")
    return sp.stationary_bootstrap(pn.indexed(series), 20, 6.0).join(own, ["t", "asset"], "left").groupBy("sample_id").agg(F.countDistinct("place").alias("places"), known)


# Distributions ------------------------------------------------------------------------------------------

_FIT = "-(count(*) / 2) * (ln(2 * pi() * var_pop(r)) + 1)"
register(
    "univariate_normal",
    f"WITH {RETURNS} SELECT asset, {q8('avg(r)')} AS loc, {q8('stddev_pop(r)')} AS scale, {q8(_FIT)} AS log_likelihood, {q8(f'4 - 2 * ({_FIT})')} AS aic, {q8(f'2 * ln(count(*)) - 2 * ({_FIT})')} AS bic FROM ret GROUP BY asset",
    lambda s, d: cp.fit_normal(monthly_returns(s, d)),
)


def taus(spark: SparkSession, d: str) -> DataFrame:
    return mx.kendall(monthly_returns(spark, d)).where("asset_i < asset_j").withColumnRenamed("v", "tau")


_TAU = "(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(sign(a.x - b.x) ** 2) * sum(sign(a.y - b.y) ** 2)))"
_CLAYTON = "ln(1 + th) - (1 + th) * (ln({u}) + ln({v})) - (2 + 1 / th) * ln({u} ** -th + {v} ** -th - 1)"
_GUMBEL = "-(((-ln({u})) ** th + (-ln({v})) ** th) ** (1 / th)) - ln({u}) - ln({v}) + (th - 1) * (ln(-ln({u})) + ln(-ln({v}))) + (2 / th - 2) * ln((-ln({u})) ** th + (-ln({v})) ** th) + ln(1 + (th - 1) / (((-ln({u})) ** th + (-ln({v})) ** th) ** (1 / th)))"
_TURNS = {0: ("u", "v"), 90: ("(1 - u)", "v"), 180: ("(1 - u)", "(1 - v)"), 270: ("u", "(1 - v)")}
_turned = lambda sql: "CASE deg " + " ".join(f"WHEN {g} THEN {sql.format(u=a, v=b)}" for g, (a, b) in _TURNS.items()) + " END"
register(
    "copula_selection",
    f"""WITH {PSEUDO}, {PAIRS[len(RETURNS) + 2:]}, ta AS (SELECT a.asset_i, a.asset_j, {_TAU} AS tau FROM pr a JOIN pr b ON a.asset_i = b.asset_i AND a.asset_j = b.asset_j AND a.t < b.t WHERE a.asset_i < a.asset_j GROUP BY 1, 2),
    ca AS (SELECT asset_i, asset_j, tau, 'clayton' AS family, CASE WHEN tau >= 0 THEN g ELSE g + 90 END AS deg, least(50.0, greatest(0.0001, 2 * abs(tau) / (1 - abs(tau)))) AS th FROM ta, (SELECT unnest([0, 180]) AS g)
           UNION ALL SELECT asset_i, asset_j, tau, 'gumbel', CASE WHEN tau >= 0 THEN g ELSE g + 90 END, least(80.0, greatest(1.0001, 1 / (1 - abs(tau)))) FROM ta, (SELECT unnest([0, 180]) AS g)),
    ll AS (SELECT asset_i, asset_j, tau, family, deg, th, sum(CASE WHEN family = 'clayton' THEN {_turned(_CLAYTON)} ELSE {_turned(_GUMBEL)} END) AS ll FROM ca JOIN uv USING (asset_i, asset_j) GROUP BY ALL),
    c AS (SELECT asset_i, asset_j, tau, family, deg, th, ll, 2 - 2 * ll AS aic FROM ll UNION ALL SELECT asset_i, asset_j, tau, 'independent', 0, NULL, 0, 0 FROM ta),
    k AS (SELECT *, row_number() OVER (PARTITION BY asset_i, asset_j ORDER BY aic, family, deg) AS k FROM c)
    SELECT asset_i, asset_j, {q8('tau')} AS tau, family, CAST(deg AS INTEGER) AS degrees, {q8('th')} AS theta, {q8('ll')} AS log_likelihood, {q8('aic')} AS aic FROM k WHERE k = 1""",
    lambda s, d: cp.select_copula(uv(s, d), taus(s, d), ("independent", "clayton", "gumbel")),
)
register("copula_selection_with_normal", None, lambda s, d: cp.select_copula(uv(s, d), taus(s, d)))
register("copula_h_normal", None, lambda s, d: uv(s, d).select("t", "asset_i", "asset_j", cp.gaussian_h(F.col("u"), F.col("v"), 0.5).alias("h")))

# Uncertainty sets, implied volatilities, regressions, bands -----------------------------------------------

_DATES = "(SELECT count(DISTINCT t) FROM ret)"
register("mean_uncertainty", f"WITH {PAIRS} SELECT asset_i, asset_j, {q8(f'covar_samp(x, y) / {_DATES}')} AS v FROM pr GROUP BY 1, 2", lambda s, d: un.mean_set(monthly_returns(s, d), diagonal=False))
register(
    "covariance_uncertainty",
    f"WITH {PAIRS}, c AS (SELECT asset_i, asset_j, covar_samp(x, y) AS v FROM pr GROUP BY 1, 2) SELECT c.asset_i, c.asset_j, {q8(f'(a.v * b.v + c.v * c.v) / {_DATES}')} AS v FROM c JOIN c a ON a.asset_i = c.asset_i AND a.asset_j = c.asset_i JOIN c b ON b.asset_i = c.asset_j AND b.asset_j = c.asset_j",
    lambda s, d: un.covariance_set(monthly_returns(s, d), diagonal=False),
)
register("mean_uncertainty_bootstrap", None, lambda s, d: un.bootstrap_mean_set(pn.indexed(whole(monthly_returns(s, d))), 200, 6.0))
register("covariance_uncertainty_bootstrap", None, lambda s, d: un.bootstrap_covariance_set(pn.indexed(whole(monthly_returns(s, d))), 50, 6.0))
register("bootstrap_block_lengths", None, lambda s, d: un.block_lengths(monthly_returns(s, d)))


def implied(spark: SparkSession, d: str) -> DataFrame:
    """Implied volatilities made from month and asset: 0.15 + 0.01 * ((7 * month + 3 * asset) mod 11) a year."""
    return monthly_returns(spark, d).select("t", "asset", (0.15 + 0.01 * ((7 * F.month("t") + 3 * F.col("asset").cast("int")) % 11)).alias("vol"))


_IV = f"""WITH {PAIRS}, iv AS (SELECT t, asset, r, 0.15::DOUBLE + 0.01::DOUBLE * ((7 * month(t) + 3 * CAST(asset AS INTEGER)) % 11) AS vol, dense_rank() OVER (ORDER BY t) - 1 AS i FROM ret),
co AS (SELECT asset_i, asset_j, corr(x, y) AS v FROM pr GROUP BY 1, 2)"""
_JOINED = f"SELECT asset_i, asset_j, {q8('co.v * a.vol * b.vol')} AS v FROM co JOIN fc a ON a.asset = asset_i JOIN fc b ON b.asset = asset_j"
register(
    "cov_implied",
    f"""{_IV}, bl AS (SELECT asset, (i - (SELECT (max(i) + 1) % 6 FROM iv)) // 6 AS block, ln(stddev_samp(r)) AS rv, ln(arg_max(vol, t) / sqrt(252)) AS iv FROM iv WHERE i >= (SELECT (max(i) + 1) % 6 FROM iv) GROUP BY 1, 2),
    ld AS (SELECT *, lead(rv) OVER (PARTITION BY asset ORDER BY block) AS y FROM bl),
    se AS (SELECT asset, covar_pop(iv, iv) AS ii, covar_pop(rv, rv) AS rr, covar_pop(iv, rv) AS ir, covar_pop(iv, y) AS iy, covar_pop(rv, y) AS ry, avg(iv) AS mi, avg(rv) AS mr, avg(y) AS my FROM ld WHERE y IS NOT NULL GROUP BY asset),
    fc AS (SELECT asset, exp(my + (iy * rr - ry * ir) / (ii * rr - ir * ir) * (l.iv - mi) + (ry * ii - iy * ir) / (ii * rr - ir * ir) * (l.rv - mr)) AS vol FROM se JOIN (SELECT asset, iv, rv FROM ld WHERE y IS NULL) l USING (asset))
    {_JOINED}""",
    lambda s, d: mx.implied_covariance(monthly_returns(s, d), implied(s, d), 6),
)
register(
    "cov_implied_premium",
    f"{_IV}, fc AS (SELECT asset, arg_max(vol, t) / sqrt(252) / 1.1::DOUBLE AS vol FROM iv GROUP BY asset) {_JOINED}",
    lambda s, d: mx.implied_covariance(monthly_returns(s, d), implied(s, d), premium=1.1),
)
register(
    "cs_ols_two_features",
    f"""WITH {PAIRED}, u AS (SELECT t, w, x, ln(w) AS z, y FROM xy WHERE y IS NOT NULL), m AS (SELECT t, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM u GROUP BY t),
    g AS (SELECT t, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, sum(w * (x - mx) ** 2) AS xx, sum(w * (z - mz) ** 2) AS zz, sum(w * (x - mx) * (z - mz)) AS xz, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (z - mz) * (y - my)) AS zy, sum(w * (y - my) ** 2) AS yy FROM u JOIN m USING (t) GROUP BY t),
    b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM g)
    SELECT {DAY}, {q8('my - bx * mx - bz * mz')} AS intercept, {q8('bx')} AS b_x, {q8('bz')} AS b_z, {q8('(bx * xy + bz * zy) / yy')} AS r2 FROM b""",
    lambda s, d: cs.regression_on(paired(s, d).withColumn("z", F.log("w")), ["x", "z"]),
)
register(
    "rolling_band",
    f"WITH {ROLL} SELECT {DAY}, {q8('quantile_cont(sd, 0.05)')} AS p5, {q8('quantile_cont(sd, 0.5)')} AS p50, {q8('quantile_cont(sd, 0.95)')} AS p95 FROM g WHERE whole GROUP BY g.t",
    lambda s, d: ms.band(ms.rolling(monthly_returns(s, d), 12), "standard_deviation"),
)

# More allocators ------------------------------------------------------------------------------------------


def diversified(spark: SparkSession, d: str) -> DataFrame:
    """What makes diversification highest: no asset's covariance with the portfolio, over its deviation, is below the portfolio's variance over its mean deviation, and those held are at it."""
    m = marginal(spark, d, "maximum_diversification").join(mx.covariance(monthly_returns(spark, d)).where("asset_i = asset_j").select(F.col("asset_i").alias("asset"), F.sqrt("v").alias("sd")), "asset")
    mean = m.agg(F.sum(F.col("weight") * F.col("sd"))).first()[0] or 1.0
    level, own = F.col("whole") / float(mean), F.col("own") / F.col("sd")
    return m.select("asset", (own >= level * (1 - 1e-4)).alias("stationary"), (F.col("weight") * (own / level - 1) <= 1e-4).alias("complementary"))


register("maximum_diversification_optimality", f"{_WHOLE} SELECT asset, true AS stationary, true AS complementary FROM a", diversified)
register(
    "schur_variance",
    "SELECT true AS invested, true AS positive, true AS below_hierarchical",
    lambda s, d: schur_against_hierarchical(s, d),
)


def schur_against_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Whether Schur-complementary weights are whole and no riskier than those of hierarchical risk parity."""
    w = allocated(spark, d, ["schur_complementary", "hierarchical_risk_parity"])
    v = ms.measure(pf.portfolio_returns(monthly_returns(spark, d), w), ["variance"], ["portfolio_id"])
    of = lambda n: F.max(F.when(F.col("portfolio_id") == n, F.col("variance")))
    less = v.agg((of("schur_complementary") <= of("hierarchical_risk_parity") * (1 + 1e-9)).alias("below_hierarchical"))
    mine = w.where("portfolio_id = 'schur_complementary'")
    return mine.agg((F.abs(F.sum("weight") - 1) < 1e-9).alias("invested"), (F.min("weight") > 0).alias("positive")).join(less)

register("stacked_weights", None, lambda s, d: allocated(s, d, ["stacked"]).select("asset", "weight"))
register(
    "stacked_budget",
    "SELECT 1.0::DOUBLE AS invested, true AS positive",
    lambda s, d: allocated(s, d, ["stacked"]).agg(F.round(F.sum("weight"), 6).alias("invested"), (F.min("weight") > -1e-9).alias("positive")),
)

# Portfolio algebra ----------------------------------------------------------------------------------------


def changed(spark: SparkSession, d: str) -> DataFrame:
    """All weights negated, made absolute, rounded, floored to hundredths, and halved."""
    w = population_weights(monthly_returns(spark, d))
    changes = {"neg": lambda x: -x, "abs": lambda x: F.abs(-x), "round": lambda x: F.round(x, 2), "floor": lambda x: F.floor(x * 100) / 100, "div": lambda x: x / 2}
    out = None
    for name, change in changes.items():
        part = pf.mapped(w, change).select(F.lit(name).alias("op"), "portfolio_id", "asset", "weight")
        out = part if out is None else out.unionByName(part)
    return out


register(
    "ptf_unary",
    f"WITH {POPULATION} SELECT op, CAST(k AS VARCHAR) AS portfolio_id, asset, {q8('CASE op WHEN ' + chr(39) + 'neg' + chr(39) + ' THEN -weight WHEN ' + chr(39) + 'abs' + chr(39) + ' THEN abs(-weight) WHEN ' + chr(39) + 'round' + chr(39) + ' THEN round(weight, 2) WHEN ' + chr(39) + 'floor' + chr(39) + ' THEN floor(weight * 100) / 100 ELSE weight / 2 END')} AS weight FROM wt, (SELECT unnest(['neg', 'abs', 'round', 'floor', 'div']) AS op)",
    changed,
)
register(
    "ptf_moments",
    f"""WITH {POPULATION}, mu AS (SELECT asset, avg(r) AS m FROM ret GROUP BY asset), cv AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) AS v FROM ret a JOIN ret b USING (t) GROUP BY 1, 2),
    va AS (SELECT a.k, sum(a.weight * b.weight * v) AS v FROM wt a JOIN cv ON i = a.asset JOIN wt b ON b.asset = j AND b.k = a.k GROUP BY 1), me AS (SELECT k, sum(weight * m) AS m FROM wt JOIN mu USING (asset) GROUP BY k)
    SELECT CAST(k AS VARCHAR) AS portfolio_id, {q8('m')} AS mean, {q8('v')} AS variance FROM me JOIN va USING (k)""",
    lambda s, d: (lambda r: pf.moments(population_weights(r), r.groupBy("asset").agg(F.avg("r").alias("mean")), mx.covariance(r)))(monthly_returns(s, d)),
)
register(
    "pop_compare",
    f"WITH {POPULATION_FRAME} SELECT a.portfolio_id AS a, b.portfolio_id AS b, a.mean >= b.mean AND a.cvar <= b.cvar AND (a.mean > b.mean OR a.cvar < b.cvar) AS dominates FROM pop a JOIN pop b ON CAST(b.portfolio_id AS INTEGER) = CAST(a.portfolio_id AS INTEGER) + 1",
    lambda s, d: pf.compare(population(s, d), s.range(10).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b")), ["mean"], ["cvar"]),
)


def held_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Inverse-volatility weights of every walk-forward split on its test dates."""
    rows = sp.assign(pn.indexed(monthly_returns(spark, d)), sp.table(spark, sp.walk_forward(_months(spark, d), 6, 24, 1)))
    w = rows.where("role = 'train'").groupBy("split_id", "asset").agg((1 / F.stddev_samp("r")).alias("v")).withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("split_id")))
    return pf.weights_by_date(w, rows.where("role = 'test'").select("split_id", "t").distinct())


register("wf_weights_by_date", f"WITH {OOS}, te AS (SELECT DISTINCT split_id, t FROM ix JOIN sp ON role = 'test' AND i >= lo AND i < hi) SELECT split_id, {DAY}, asset, {q8('weight')} AS weight FROM te JOIN ww USING (split_id)", held_by_date)

# Online search, draws -------------------------------------------------------------------------------------

register(
    "online_half_life_search",
    f"""WITH {RETURNS}, h AS (SELECT unnest([3.0, 6.0, 12.0, 24.0]::DOUBLE[]) AS half_life), ag AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS i FROM ret),
    fc AS (SELECT b.asset, half_life, b.i, b.r, sum((1 - pow(2, -1 / half_life)) * pow(pow(2, -1 / half_life), b.i - 1 - a.i) * a.r * a.r) / (1 - pow(pow(2, -1 / half_life), b.i - 1)) AS v FROM ag a JOIN ag b ON a.asset = b.asset AND a.i < b.i, h WHERE b.i > 12 GROUP BY 1, 2, 3, 4),
    sc AS (SELECT asset, half_life, avg(ln(v) + r * r / v) AS score, CAST(count(*) AS INTEGER) AS n FROM fc GROUP BY 1, 2)
    SELECT asset, half_life, {q8('score')} AS score, n, row_number() OVER (PARTITION BY asset ORDER BY sc.score, half_life) = 1 AS best FROM sc""",
    lambda s, d: ew.search_half_life(monthly_returns(s, d), [3, 6, 12, 24], 12),
)
register(
    # The shares of draws below both medians, against the copulas' values there.
    "copula_samples",
    "SELECT 200000 AS n, round((0.5 ** -2.0 + 0.5 ** -2.0 - 1) ** (-0.5), 2) AS clayton, round(0.25 + asin(0.6) / (2 * pi()), 2) AS normal",
    lambda s, d: draws(s),
)


def draws(spark: SparkSession) -> DataFrame:
    low = F.round(F.avg(((F.col("u") <= 0.5) & (F.col("v") <= 0.5)).cast("double")), 2)
    part = lambda name, inverse, theta: cp.sample(spark, 200_000, inverse, theta).agg(F.count("*").cast("int").alias("n"), low.alias(name))
    return part("clayton", cp.clayton_inverse_h, 2.0).join(part("normal", cp.gaussian_inverse_h, 0.6), "n")


register("univariate_selection", None, lambda s, d: di.fit(monthly_returns(s, d)))
register(
    # Families that hold the normal as a limit cannot be less likely than it.
    "univariate_likelihoods",
    f"WITH {RETURNS} SELECT asset, {q8(_FIT)} AS normal, true AS student_t, true AS one_best FROM ret GROUP BY asset",
    lambda s, d: di.fit(monthly_returns(s, d)).groupBy("asset").agg(*(F.max(F.when(F.col("family") == f, F.col("log_likelihood"))).alias(f) for f in ("normal", "student_t")), (F.count_if("best") == 1).alias("one_best")).withColumn("student_t", F.col("student_t") >= F.col("normal") - 1e-3),
)
register("copula_fit_student", None, lambda s, d: cp.fit_student(uv(s, d), taus(s, d)))
register("copula_h_student", None, lambda s, d: uv(s, d).select("t", "asset_i", "asset_j", cp.student_h(F.col("u"), F.col("v"), 0.5, 4.0).alias("h")))
