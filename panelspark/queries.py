"""Registered queries of the portfolio engine, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import cross_section as cs
from .operators import matrices as mx
from .operators import measures as ms
from .operators import panel as pn
from .sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def r8(x: Column | str) -> Column:
    """Rounded to 8 decimals, without a negative zero."""
    return F.round(x, 8) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates as strings."""
    return df.select(*(r8(F.col(k)).alias(k) if kind == "double" else F.date_format(k, "yyyy-MM-dd").alias(k) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(k) for k, kind in df.dtypes))


def register(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE_SQL[name] = sql


MONTHLY = """
px AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, CAST(s_nationkey AS VARCHAR) AS asset, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS volume
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
DAILY = MONTHLY.replace("date_trunc('month', l_shipdate)", "l_shipdate")
BRANDS = """
bx AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, p_brand AS asset, avg(l_extendedprice / l_quantity) AS price
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RETURNS = MONTHLY + """,
ret AS (SELECT t, asset, r FROM (SELECT t, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY t) - 1 AS r FROM px) WHERE r IS NOT NULL)"""
DAY = "strftime(t, '%Y-%m-%d') AS t"


def q8(x: str) -> str:
    return f"round({x}, 8) + 0.0"


def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    return pn.linear_returns(panels.monthly(spark, d))


# Panels -------------------------------------------------------------------------------------------

register("returns_linear", f"WITH {RETURNS} SELECT {DAY}, asset, {q8('r')} AS r FROM ret", monthly_returns)
register("returns_log", f"WITH {RETURNS} SELECT {DAY}, asset, {q8('ln(1 + r)')} AS r FROM ret", lambda s, d: pn.log_returns(panels.monthly(s, d)))

GRID = DAILY + """,
grid AS (SELECT t, asset, price FROM (SELECT DISTINCT t FROM px) CROSS JOIN (SELECT DISTINCT asset FROM px) LEFT JOIN px USING (t, asset)),
counted AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, count(*) OVER (PARTITION BY t) - count(price) OVER (PARTITION BY t) AS m FROM grid),
dense AS (SELECT t, asset, price FROM counted WHERE m <= n * 0.5),
filled AS (SELECT t, asset, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS price FROM dense),
begun AS (SELECT t, asset, price FROM (SELECT *, count(*) OVER (PARTITION BY t) - count(price) OVER (PARTITION BY t) AS m FROM filled) WHERE m = 0)"""
register("nan_threshold_filter", f"WITH {GRID} SELECT {DAY}, asset, {q8('price')} AS price FROM dense", lambda s, d: pn.drop_sparse_rows(pn.full_grid(panels.daily(s, d)), 0.5))
register("forward_fill", f"WITH {GRID} SELECT {DAY}, asset, {q8('price')} AS price FROM filled", lambda s, d: pn.forward_fill(pn.drop_sparse_rows(pn.full_grid(panels.daily(s, d)), 0.5)))
register(
    "returns_ffill_dropna",
    f"WITH {GRID} SELECT * FROM (SELECT {DAY}, asset, {q8('price / lag(price) OVER (PARTITION BY asset ORDER BY begun.t) - 1')} AS r FROM begun) WHERE r IS NOT NULL",
    lambda s, d: pn.prices_to_returns(panels.daily(s, d), 0.5),
)
register(
    "factor_join_outer",
    f"WITH {MONTHLY}, {BRANDS}, f AS (SELECT t, avg(price) AS factor FROM bx GROUP BY t), a AS (SELECT t, asset, price FROM px) SELECT {DAY}, asset, {q8('price')} AS price, {q8('factor')} AS factor FROM a FULL JOIN f USING (t)",
    lambda s, d: pn.join_factors(panels.monthly(s, d), panels.brands(s, d).groupBy("t").agg(F.avg("price").alias("factor"))),
)
register("tail_window", f"WITH {RETURNS} SELECT {DAY}, asset, {q8('r')} AS r FROM ret WHERE ret.t IN (SELECT DISTINCT t FROM ret ORDER BY t DESC LIMIT 24)", lambda s, d: pn.tail(monthly_returns(s, d), 24))

# Measures -----------------------------------------------------------------------------------------

FRAME = RETURNS + """,
f0 AS (SELECT *, avg(r) OVER (PARTITION BY asset) AS m, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY r, t) AS rn,
              sum(r) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum FROM ret),
f1 AS (SELECT *, cum - max(cum) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS dd FROM f0),
f AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dd, t) AS drn, (1.0::DOUBLE - 0.95::DOUBLE) * n AS k, greatest(0, ceil((1.0::DOUBLE - 0.95::DOUBLE) * n) - 1) AS i FROM f1)"""


def _tail(x: str, rn: str) -> str:
    return f"-sum(CASE WHEN {rn} <= i THEN {x} / k ELSE 0 END) + sum(CASE WHEN {rn} = i + 1 THEN {x} * (i / k - 1) ELSE 0 END)"


MEASURE_SQL = {
    "mean": "avg(r)",
    "mean_absolute_deviation": "avg(abs(r - m))",
    "first_lower_partial_moment": "avg(greatest(0, m - r))",
    "variance": "var_samp(r)",
    "semi_variance": "sum(greatest(0, m - r) ** 2) / (count(*) - 1)",
    "standard_deviation": "stddev_samp(r)",
    "semi_deviation": "sqrt(sum(greatest(0, m - r) ** 2) / (count(*) - 1))",
    "third_central_moment": "avg((r - m) ** 3)",
    "fourth_central_moment": "avg((r - m) ** 4)",
    "skew": "avg((r - m) ** 3) / var_pop(r) ** 1.5",
    "kurtosis": "avg((r - m) ** 4) / var_pop(r) ** 2",
    "fourth_lower_partial_moment": "avg(greatest(0, m - r) ** 4)",
    "worst_realization": "-min(r)",
    "value_at_risk": "-max(CASE WHEN rn = i + 1 THEN r END)",
    "cvar": _tail("r", "rn"),
    "entropic_risk_measure": "ln(avg(exp(-r)) / (1.0::DOUBLE - 0.95::DOUBLE))",
    "drawdown_at_risk": "-max(CASE WHEN drn = i + 1 THEN dd END)",
    "max_drawdown": "-min(dd)",
    "average_drawdown": "-avg(dd)",
    "cdar": _tail("dd", "drn"),
    "ulcer_index": "sqrt(avg(dd * dd))",
    "gini_mean_difference": "sum((4 * rn - 2 * (n + 1)) / (n * (n - 1)) * r)",
}
for _name, _sql in MEASURE_SQL.items():
    register(f"m_{_name}", f"WITH {FRAME} SELECT asset, {q8(_sql)} AS {_name} FROM f GROUP BY asset", lambda s, d, name=_name: ms.measure(monthly_returns(s, d), [name]))

_risk = {x: MEASURE_SQL[ms.RATIO_RISK.get(x, x.removesuffix("_ratio"))] for x in ms.RATIOS}
register("ratios_all", f"WITH {FRAME} SELECT asset, " + ", ".join(f"{q8(f'avg(r) / ({v})')} AS {x}" for x, v in _risk.items()) + " FROM f GROUP BY asset", lambda s, d: ms.ratios(monthly_returns(s, d)))
_y = {"mean": "avg(r) * 252", "variance": "var_samp(r) * 252", "semi_variance": MEASURE_SQL["semi_variance"] + " * 252", "standard_deviation": "stddev_samp(r) * sqrt(252)", "semi_deviation": MEASURE_SQL["semi_deviation"] + " * sqrt(252)", "sharpe_ratio": "avg(r) * 252 / (stddev_samp(r) * sqrt(252))"}
register("annualized_measures", f"WITH {FRAME} SELECT asset, " + ", ".join(f"{q8(v)} AS annualized_{x}" for x, v in _y.items()) + " FROM f GROUP BY asset", lambda s, d: ms.annualized(monthly_returns(s, d)))

WEIGHTED = RETURNS + """,
w0 AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS k FROM ret),
w1 AS (SELECT *, k / sum(k) OVER (PARTITION BY asset) AS p FROM w0),
w2 AS (SELECT *, sum(p * r) OVER (PARTITION BY asset) AS m, sum(p) OVER (PARTITION BY asset ORDER BY r, t ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY asset ORDER BY r, t) AS rn FROM w1),
w AS (SELECT *, min(CASE WHEN upto >= 1.0::DOUBLE - 0.95::DOUBLE THEN rn END) OVER (PARTITION BY asset) AS edge FROM w2)"""


def with_weights(series: DataFrame) -> DataFrame:
    by = Window.partitionBy("asset")
    ranked = series.withColumn("k", F.row_number().over(by.orderBy("t")))
    return ranked.withColumn("p", F.col("k") / F.sum("k").over(by)).drop("k")


register(
    "measures_weighted",
    f"""WITH {WEIGHTED} SELECT asset, {q8('sum(p * r)')} AS mean, {q8('sum(p * abs(r - m))')} AS mean_absolute_deviation, {q8('sum(p * greatest(0, m - r))')} AS first_lower_partial_moment,
    {q8('sum(p * (r - m) ** 2) / (1 - sum(p * p))')} AS variance, {q8('sum(p * greatest(0, m - r) ** 2) / (1 - sum(p * p))')} AS semi_variance,
    {q8('sum(p * (r - m) ** 3) / sum(p * (r - m) ** 2) ** 1.5')} AS skew, {q8('sum(p * (r - m) ** 4) / sum(p * (r - m) ** 2) ** 2')} AS kurtosis,
    {q8('-max(CASE WHEN rn = edge THEN r END)')} AS value_at_risk,
    {q8("CASE WHEN max(edge) = 1 THEN -min(r) ELSE -(sum(CASE WHEN rn < edge THEN p * r WHEN rn = edge THEN r * (1.0::DOUBLE - 0.95::DOUBLE - (upto - p)) ELSE 0 END)) / (1.0::DOUBLE - 0.95::DOUBLE) END")} AS cvar
    FROM w GROUP BY asset""",
    lambda s, d: ms.weighted_measures(with_weights(monthly_returns(s, d))),
)

# Windows ------------------------------------------------------------------------------------------

register("cumret", f"WITH {FRAME} SELECT {DAY}, asset, {q8('cum')} AS cumulative FROM f", lambda s, d: ms.cumulative(monthly_returns(s, d), ["asset"]).drop("r"))
register("cumret_compounded", f"WITH {RETURNS} SELECT {DAY}, asset, {q8('product(1 + r) OVER (PARTITION BY asset ORDER BY ret.t ROWS UNBOUNDED PRECEDING)')} AS cumulative FROM ret", lambda s, d: ms.cumulative(monthly_returns(s, d), ["asset"], True).drop("r"))
register("drawdown", f"WITH {FRAME} SELECT {DAY}, asset, {q8('dd')} AS drawdown FROM f", lambda s, d: ms.drawdowns(ms.cumulative(monthly_returns(s, d), ["asset"]), ["asset"]).drop("r", "cumulative"))
ROLL = RETURNS + """,
h AS (SELECT t, asset, r, list(r) OVER w AS l, avg(r) OVER w AS m, stddev_samp(r) OVER w AS sd FROM ret WINDOW w AS (PARTITION BY asset ORDER BY t ROWS 11 PRECEDING)),
g AS (SELECT *, len(l) = 12 AS whole FROM h),
run AS (SELECT t, asset, i, list_sum(l[1:i]) AS c FROM g, unnest(range(1, 13)) AS u(i) WHERE whole),
top AS (SELECT t, asset, c - max(c) OVER (PARTITION BY t, asset ORDER BY i ROWS UNBOUNDED PRECEDING) AS dd FROM run),
worst AS (SELECT t, asset, -min(dd) AS dd FROM top GROUP BY t, asset)"""
register(
    "rolling_measures",
    f"WITH {ROLL} SELECT {DAY}, asset, {q8('CASE WHEN whole THEN m END')} AS mean, {q8('CASE WHEN whole THEN sd END')} AS standard_deviation, {q8('CASE WHEN whole THEN m / sd END')} AS sharpe_ratio, {q8('CASE WHEN whole THEN -list_min(l) END')} AS value_at_risk, {q8('dd')} AS max_drawdown FROM g LEFT JOIN worst USING (t, asset)",
    lambda s, d: ms.rolling(monthly_returns(s, d), 12),
)

# Cross-section ------------------------------------------------------------------------------------

SECTION = RETURNS + """,
x AS (SELECT t, asset, r AS x, volume AS w, CAST(n_regionkey AS INTEGER) AS grp FROM ret JOIN px USING (t, asset) JOIN nation ON CAST(n_nationkey AS VARCHAR) = asset)"""
PAIRED = SECTION + ", xy AS (SELECT *, lead(x) OVER (PARTITION BY asset ORDER BY t) AS y FROM x)"


def paired(spark: SparkSession, d: str) -> DataFrame:
    return panels.cross_section(spark, d).withColumn("y", F.lead("x").over(pn.by_time()))


register("cs_zscore", f"WITH {SECTION} SELECT {DAY}, asset, {q8('coalesce((x - (sum(x * w) OVER a) / (sum(w) OVER a)) / (stddev_samp(x) OVER a), 0)')} AS z FROM x WINDOW a AS (PARTITION BY x.t)", lambda s, d: cs.zscore(panels.cross_section(s, d)).select("t", "asset", "z"))
register(
    "cs_zscore_grouped",
    f"""WITH {SECTION}, g AS (SELECT *, CASE WHEN count(*) OVER b >= 5 THEN (x - sum(x * w) OVER b / sum(w) OVER b) / stddev_samp(x) OVER b ELSE (x - sum(x * w) OVER a / sum(w) OVER a) / stddev_samp(x) OVER a END AS z0
    FROM x WINDOW a AS (PARTITION BY t), b AS (PARTITION BY t, grp))
    SELECT {DAY}, asset, {q8('(z0 - sum(z0 * w) OVER a / sum(w) OVER a) / stddev_samp(z0) OVER a')} AS z FROM g WINDOW a AS (PARTITION BY g.t)""",
    lambda s, d: cs.zscore_grouped(panels.cross_section(s, d), 5).select("t", "asset", "z"),
)
_rank = "greatest(0.5 / count(*) OVER {k}, least(1 - 0.5 / count(*) OVER {k}, ((count(*) OVER ({p} ORDER BY x)) - (count(*) OVER ({p}, x)) / 2) / count(*) OVER {k}))"
register("cs_percentile_rank", f"WITH {SECTION} SELECT {DAY}, asset, {q8(_rank.format(k='a', p='PARTITION BY x.t'))} AS rank FROM x WINDOW a AS (PARTITION BY x.t)", lambda s, d: cs.percentile_rank(panels.cross_section(s, d)).select("t", "asset", "rank"))
register(
    "cs_percentile_rank_grouped",
    f"WITH {SECTION} SELECT {DAY}, asset, {q8('CASE WHEN count(*) OVER b >= 5 THEN ' + _rank.format(k='b', p='PARTITION BY x.t, grp') + ' ELSE ' + _rank.format(k='a', p='PARTITION BY x.t') + ' END')} AS rank FROM x WINDOW a AS (PARTITION BY x.t), b AS (PARTITION BY x.t, grp)",
    lambda s, d: cs.percentile_rank_grouped(panels.cross_section(s, d), 5).select("t", "asset", "rank"),
)
register("cs_gaussian_rank", None, lambda s, d: cs.gaussian_rank(panels.cross_section(s, d)))
register("cs_winsor", f"WITH {SECTION}, b AS (SELECT t, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x GROUP BY t) SELECT {DAY}, asset, {q8('greatest(lo, least(hi, x))')} AS y FROM x JOIN b USING (t)", lambda s, d: cs.winsorize(panels.cross_section(s, d)).select("t", "asset", "y"))
register(
    "cs_tanh",
    f"WITH {SECTION}, c AS (SELECT t, median(x) AS c FROM x GROUP BY t), sp AS (SELECT t, median(abs(x - c)) * 1.4826022185056018 * 3 AS h FROM x JOIN c USING (t) GROUP BY t) SELECT {DAY}, asset, {q8('c + h * tanh((x - c) / h)')} AS y FROM x JOIN c USING (t) JOIN sp USING (t) WHERE h > 0",
    lambda s, d: cs.tanh_shrink(panels.cross_section(s, d)).select("t", "asset", "y"),
)
CENTRED = PAIRED + ", v AS (SELECT *, x - sum(w * x) OVER a / sum(w) OVER a AS dx, y - sum(w * y) OVER a / sum(w) OVER a AS dy, sum(w * x) OVER a / sum(w) OVER a AS mx, sum(w * y) OVER a / sum(w) OVER a AS my FROM xy WHERE y IS NOT NULL WINDOW a AS (PARTITION BY t))"
register("cs_corr", f"WITH {CENTRED} SELECT {DAY}, {q8('CASE WHEN count(*) >= 3 THEN sum(w * dx * dy) / sqrt(sum(w * dx * dx) * sum(w * dy * dy)) END')} AS corr FROM v GROUP BY v.t", lambda s, d: cs.weighted_correlation(paired(s, d)))
register("cs_rank_corr", f"WITH {PAIRED}, k AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY x, asset) AS a, row_number() OVER (PARTITION BY t ORDER BY y, asset) AS b FROM xy WHERE y IS NOT NULL) SELECT {DAY}, {q8('CASE WHEN count(*) >= 3 THEN corr(a, b) END')} AS corr FROM k GROUP BY k.t", lambda s, d: cs.rank_correlation(paired(s, d)))
register("cs_ols", f"WITH {CENTRED}, e AS (SELECT t, sum(w * dx * dx) AS xx, sum(w * dx * dy) AS xy, sum(w * dy * dy) AS yy, any_value(mx) AS mx, any_value(my) AS my FROM v GROUP BY t) SELECT {DAY}, {q8('xy / xx')} AS slope, {q8('my - xy / xx * mx')} AS intercept, {q8('xy * xy / (xx * yy)')} AS r2 FROM e", lambda s, d: cs.regression(paired(s, d)))

# Matrices -----------------------------------------------------------------------------------------

PAIRS = RETURNS + ", pr AS (SELECT t, a.asset AS asset_i, b.asset AS asset_j, a.r AS x, b.r AS y FROM ret a JOIN ret b USING (t))"
_dist = "sqrt(greatest(0, least(1, 0.5 * (1 - {}))))"
register("cov_empirical", f"WITH {PAIRS} SELECT asset_i, asset_j, {q8('covar_samp(x, y)')} AS v FROM pr GROUP BY 1, 2", lambda s, d: mx.covariance(monthly_returns(s, d)))
register("corr_pearson", f"WITH {PAIRS} SELECT asset_i, asset_j, {q8('corr(x, y)')} AS v FROM pr GROUP BY 1, 2", lambda s, d: mx.correlation(monthly_returns(s, d)))
register("dist_pearson", f"WITH {PAIRS} SELECT asset_i, asset_j, {q8(_dist.format('corr(x, y)'))} AS v FROM pr WHERE asset_i <> asset_j GROUP BY 1, 2", lambda s, d: mx.pearson_distance(monthly_returns(s, d)).where("asset_i <> asset_j"))
register("dist_spearman", f"WITH {RETURNS}, k AS (SELECT t, asset, rank() OVER (PARTITION BY asset ORDER BY r) + (count(*) OVER (PARTITION BY asset, r) - 1) / 2 AS r FROM ret) SELECT a.asset AS asset_i, b.asset AS asset_j, {q8(_dist.format('corr(a.r, b.r)'))} AS v FROM k a JOIN k b USING (t) WHERE a.asset <> b.asset GROUP BY 1, 2", lambda s, d: mx.spearman_distance(monthly_returns(s, d)).where("asset_i <> asset_j"))
register("dist_kendall", f"WITH {PAIRS} SELECT a.asset_i, a.asset_j, {q8(_dist.format('(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(sign(a.x - b.x) ** 2) * sum(sign(a.y - b.y) ** 2)))'))} AS v FROM pr a JOIN pr b ON a.asset_i = b.asset_i AND a.asset_j = b.asset_j AND a.t < b.t WHERE a.asset_i < a.asset_j GROUP BY 1, 2", lambda s, d: mx.kendall_distance(monthly_returns(s, d)).where("asset_i < asset_j"))
GERBER = RETURNS + """,
u AS (SELECT t, asset, sd, CASE WHEN r >= 0.5 * sd THEN 1 ELSE 0 END AS up, CASE WHEN r <= -0.5 * sd THEN 1 ELSE 0 END AS dn FROM (SELECT *, stddev_pop(r) OVER (PARTITION BY asset) AS sd FROM ret)),
gp AS (SELECT a.asset AS asset_i, b.asset AS asset_j, sum(a.up * b.up + a.dn * b.dn - a.up * b.dn - a.dn * b.up) AS h, count(*) - sum((1 - a.up - a.dn) * (1 - b.up - b.dn)) AS n, any_value(a.sd) AS si, any_value(b.sd) AS sj FROM u a JOIN u b USING (t) GROUP BY 1, 2)"""
register("cov_gerber", f"WITH {GERBER} SELECT asset_i, asset_j, {q8('h / n * si * sj')} AS v FROM gp", lambda s, d: mx.gerber(monthly_returns(s, d)))
register("cov_gerber_basic", f"WITH {GERBER} SELECT g.asset_i, g.asset_j, {q8('g.h / sqrt(a.h * b.h) * g.si * g.sj')} AS v FROM gp g JOIN gp a ON a.asset_i = g.asset_i AND a.asset_j = g.asset_i JOIN gp b ON b.asset_i = g.asset_j AND b.asset_j = g.asset_j", lambda s, d: mx.gerber(monthly_returns(s, d), psd=False))
_lam = "pow(2.0::DOUBLE, -1.0 / 12)"
EW = RETURNS + ", ag AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t DESC) - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM ret)"
register("ew_mu", f"WITH {EW} SELECT asset, {q8(f'sum((1 - {_lam}) * pow({_lam}, k) * r) / (1 - pow({_lam}, count(*)))')} AS mean FROM ag GROUP BY asset", lambda s, d: mx.ew_mean(monthly_returns(s, d), 12))
register("ew_var", f"WITH {EW} SELECT asset, {q8(f'sum((1 - {_lam}) * pow({_lam}, k) * r * r) / (1 - pow({_lam}, count(*)))')} AS variance FROM ag GROUP BY asset", lambda s, d: mx.ew_variance(monthly_returns(s, d), 12))
register("ew_cov", f"WITH {EW}, p AS (SELECT a.asset AS asset_i, b.asset AS asset_j, a.r AS x, b.r AS y, a.n AS ni, b.n AS nj, row_number() OVER (PARTITION BY a.asset, b.asset ORDER BY a.t DESC) - 1 AS k FROM ag a JOIN ag b USING (t)) SELECT asset_i, asset_j, {q8(f'sum((1 - {_lam}) * pow({_lam}, k) * x * y) / sqrt((1 - pow({_lam}, any_value(ni))) * (1 - pow({_lam}, any_value(nj))))')} AS v FROM p GROUP BY 1, 2", lambda s, d: mx.ew_covariance(monthly_returns(s, d), 12))
register("mu_equilibrium", f"WITH {PAIRS}, c AS (SELECT asset_i, asset_j, covar_samp(x, y) AS v FROM pr GROUP BY 1, 2) SELECT asset_i AS asset, {q8('avg(v)')} AS mean FROM c GROUP BY 1", lambda s, d: mx.equilibrium_mean(monthly_returns(s, d)))
register("inv_vol_weights", f"WITH {RETURNS}, v AS (SELECT asset, 1 / stddev_samp(r) AS v FROM ret GROUP BY asset) SELECT asset, {q8('v / sum(v) OVER ()')} AS weight FROM v", lambda s, d: mx.inverse_volatility(monthly_returns(s, d)))


# Portfolios ---------------------------------------------------------------------------------------

from .operators import portfolios as pf  # noqa: E402
from .operators import selection as sel  # noqa: E402
from .plans import splits as sp  # noqa: E402

EQUAL = RETURNS + """,
eq AS (SELECT t, sum(r / (SELECT count(DISTINCT asset) FROM ret)) AS r FROM ret GROUP BY t HAVING count(*) = (SELECT count(DISTINCT asset) FROM ret))"""
EQUAL_FRAME = EQUAL + FRAME[len(RETURNS):].replace("PARTITION BY asset ORDER BY", "ORDER BY").replace("PARTITION BY asset", "").replace("FROM ret", "FROM eq")
HEADLINE = ("mean", "variance", "standard_deviation", "semi_deviation", "value_at_risk", "cvar", "max_drawdown")


def equal_weight(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: returns, an equal-weight portfolio, and its measures in one row."""
    series = monthly_returns(spark, d)
    m = ms.measure(pf.portfolio_returns(series, pf.equal_weights(series)), HEADLINE, ["portfolio_id"])
    return m.withColumn("sharpe_ratio", F.col("mean") / F.col("standard_deviation")).withColumn("annualized_sharpe_ratio", F.col("sharpe_ratio") * F.sqrt(F.lit(252.0)))


register(
    "ptf_equal_weight",
    f"WITH {EQUAL_FRAME} SELECT 'equal' AS portfolio_id, " + ", ".join(f"{q8(MEASURE_SQL[x])} AS {x}" for x in HEADLINE) + f", {q8('avg(r) / stddev_samp(r)')} AS sharpe_ratio, {q8('avg(r) / stddev_samp(r) * sqrt(252)')} AS annualized_sharpe_ratio FROM f",
    equal_weight,
)
#: A population with weights from ids: weight of asset a in portfolio k in proportion to 1 + (a * (k + 3) + 7k) mod 11.
POPULATION = RETURNS + """,
wt AS (SELECT k, asset, v / sum(v) OVER (PARTITION BY k) AS weight FROM (SELECT k, asset, 1 + (CAST(asset AS INTEGER) * (k + 3) + 7 * k) % 11 AS v FROM (SELECT DISTINCT asset FROM ret), range(11) AS u(k))),
pr0 AS (SELECT k, t, sum(weight * r) AS r, count(*) AS c FROM ret JOIN wt USING (asset) GROUP BY k, t),
pop_r AS (SELECT CAST(k AS VARCHAR) AS asset, t, r FROM pr0 WHERE c = (SELECT count(DISTINCT asset) FROM ret))"""
POPULATION_FRAME = POPULATION + FRAME[len(RETURNS):].replace("FROM ret", "FROM pop_r") + f",\npop AS MATERIALIZED (SELECT asset AS portfolio_id, {q8('avg(r)')} AS mean, {q8('stddev_samp(r)')} AS standard_deviation, {q8(_tail('r', 'rn'))} AS cvar, {q8('-min(dd)')} AS max_drawdown FROM f GROUP BY asset)"


def population_weights(series: DataFrame) -> DataFrame:
    k = series.select("asset").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    v = 1 + (F.col("asset").cast("int") * (F.col("k") + 3) + 7 * F.col("k")) % 11
    return k.withColumn("v", v).select(F.col("k").cast("string").alias("portfolio_id"), "asset", (F.col("v") / F.sum("v").over(Window.partitionBy("k"))).alias("weight"))


def population(spark: SparkSession, d: str) -> DataFrame:
    series = monthly_returns(spark, d)
    r = pf.portfolio_returns(series, population_weights(series)).where("r is not null")
    # Rounded, so that dominance does not hang on the order in which sums were made.
    return rounded(ms.measure(r, ["mean", "standard_deviation", "cvar", "max_drawdown"], ["portfolio_id"]))


_P = "portfolio_id, " + ", ".join(f"{q8(x)} AS {x}" for x in ("mean", "standard_deviation", "cvar", "max_drawdown"))
register("pop_summary", f"WITH {POPULATION_FRAME} SELECT {_P} FROM pop", population)
register("pop_quantile", f"WITH {POPULATION_FRAME}, k AS (SELECT *, row_number() OVER (ORDER BY cvar, portfolio_id) - 1 AS i FROM pop) SELECT {_P} FROM k WHERE i = 3", lambda s, d: pf.quantile(population(s, d), "cvar", 0.35))
register("pop_min_max_mean_std", f"WITH {POPULATION_FRAME} SELECT arg_min(portfolio_id, cvar) AS least, arg_max(portfolio_id, cvar) AS most, {q8('avg(cvar)')} AS mean, {q8('stddev_pop(cvar)')} AS deviation FROM pop", lambda s, d: pf.extremes(population(s, d), "cvar"))
_dom = "EXISTS (SELECT 1 FROM {b} b WHERE b.mean >= a.mean AND b.cvar <= a.cvar AND (b.mean > a.mean OR b.cvar < a.cvar))"
register("pop_front0", f"WITH {POPULATION_FRAME} SELECT {_P} FROM pop a WHERE NOT {_dom.format(b='pop')}", lambda s, d: pf.first_front(population(s, d), ["mean"], ["cvar"]))
register(
    "pop_fronts",
    # A portfolio's front is the length of the longest chain of portfolios above it, each dominating the next.
    f"""WITH RECURSIVE {POPULATION_FRAME}, above AS MATERIALIZED (SELECT q.portfolio_id AS up, a.portfolio_id AS id FROM pop q, pop a WHERE q.mean >= a.mean AND q.cvar <= a.cvar AND (q.mean > a.mean OR q.cvar < a.cvar)),
    chain AS (SELECT portfolio_id, 0 AS front FROM pop UNION SELECT above.id, chain.front + 1 FROM chain JOIN above ON chain.portfolio_id = above.up)
    SELECT portfolio_id, CAST(max(front) AS INTEGER) AS front FROM chain GROUP BY 1""",
    lambda s, d: pf.fronts(population(s, d), ["mean"], ["cvar"]).select("portfolio_id", "front"),
)
register("pop_filter_sort", f"WITH {POPULATION_FRAME} SELECT {_P}, CAST(row_number() OVER (ORDER BY cvar DESC, portfolio_id) AS INTEGER) AS place FROM pop WHERE portfolio_id IN ('1', '3', '5', '7')", lambda s, d: population(s, d).where(F.col("portfolio_id").isin("1", "3", "5", "7")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cvar"), "portfolio_id"))))

COSTS = POPULATION + ", cost AS (SELECT k, sum(0.001 * abs(0.04 - weight) + 0.0005 * weight) AS cost FROM wt GROUP BY k)"


def with_costs(s: SparkSession, d: str) -> DataFrame:
    series = monthly_returns(s, d)
    weights = population_weights(series)
    assets = series.select("asset").distinct()
    cost = pf.costs_and_fees(weights, assets.withColumn("previous", F.lit(0.04)), assets.select("asset", F.lit(0.001).alias("cost_rate"), F.lit(0.0005).alias("fee_rate")))
    return pf.portfolio_returns(series, weights, cost)


register("ptf_costs_fees", f"WITH {COSTS} SELECT CAST(k AS VARCHAR) AS portfolio_id, {DAY}, {q8('CASE WHEN c = (SELECT count(DISTINCT asset) FROM ret) THEN r - cost END')} AS r FROM pr0 JOIN cost USING (k)", with_costs)
register("ptf_composition", f"WITH {POPULATION} SELECT CAST(k AS VARCHAR) AS portfolio_id, asset, {q8('weight')} AS weight, CAST(row_number() OVER (PARTITION BY k ORDER BY weight DESC, asset) AS INTEGER) AS rank FROM wt", lambda s, d: pf.composition(population_weights(monthly_returns(s, d))))
register("effective_number_assets", f"WITH {POPULATION} SELECT CAST(k AS VARCHAR) AS portfolio_id, {q8('1 / sum(weight * weight)')} AS effective_number_assets FROM wt GROUP BY k", lambda s, d: pf.effective_assets(population_weights(monthly_returns(s, d))))
register("ptf_add_scale", f"WITH {POPULATION} SELECT 'mix' AS portfolio_id, asset, {q8('sum(CASE WHEN k = 1 THEN weight ELSE -weight END) * 0.5')} AS weight FROM wt WHERE k IN (1, 2) GROUP BY asset", lambda s, d: (lambda w: pf.scaled(pf.combine(w.where("portfolio_id = '1'"), w.where("portfolio_id = '2'"), "mix", -1), 0.5))(population_weights(monthly_returns(s, d))))
register(
    "contribution_variance",
    f"""WITH {PAIRS}, full_t AS (SELECT t FROM ret GROUP BY t HAVING count(*) = (SELECT count(DISTINCT asset) FROM ret)), c AS (SELECT asset_i, asset_j, covar_samp(x, y) AS v FROM pr WHERE t IN (SELECT t FROM full_t) GROUP BY 1, 2)
    SELECT 'equal' AS portfolio_id, asset_i AS asset, round(2 * avg(v) / count(*), 6) + 0.0 AS contribution FROM c GROUP BY 2""",
    lambda s, d: (lambda series: pf.contribution(series, pf.equal_weights(series), "variance").withColumn("contribution", F.round("contribution", 6)))(monthly_returns(s, d)),
)
register("ptf_diversification", f"WITH {EQUAL}, o AS (SELECT avg(sd) AS top FROM (SELECT stddev_pop(r) AS sd FROM ret GROUP BY asset)) SELECT 'equal' AS portfolio_id, {q8('any_value(top) / stddev_samp(r)')} AS diversification FROM eq, o", lambda s, d: (lambda series: pf.diversification(series, pf.equal_weights(series)))(monthly_returns(s, d)))
register("ptf_sric", f"WITH {EQUAL} SELECT 'equal' AS portfolio_id, {q8('avg(r) / stddev_samp(r) - (SELECT count(DISTINCT asset) FROM ret) / (count(*) * (avg(r) / stddev_samp(r)))')} AS sric FROM eq", lambda s, d: (lambda series: pf.sric(series, pf.equal_weights(series)))(monthly_returns(s, d)))
register("ptf_returns_pivot", f"WITH {POPULATION} SELECT {DAY}, {q8('max(CASE WHEN asset = ' + chr(39) + '0' + chr(39) + ' THEN r END)')} AS p0, {q8('max(CASE WHEN asset = ' + chr(39) + '1' + chr(39) + ' THEN r END)')} AS p1 FROM pop_r GROUP BY pop_r.t", lambda s, d: (lambda series: pf.portfolio_returns(series, population_weights(series)).where("r is not null").groupBy("t").pivot("portfolio_id", ["0", "1"]).agg(F.first("r")).withColumnsRenamed({"0": "p0", "1": "p1"}))(monthly_returns(s, d)))

# Selection ----------------------------------------------------------------------------------------

register("sel_zero_variance", f"WITH {RETURNS} SELECT asset FROM ret GROUP BY asset HAVING var_pop(r) > 0.004", lambda s, d: sel.keep_varying(monthly_returns(s, d), 0.004))
_grid = GRID[: GRID.index(",\ncounted")]
register("sel_complete", f"WITH {_grid} SELECT asset FROM grid GROUP BY asset HAVING (arg_min_null(price, t) IS NOT NULL) AND (arg_max_null(price, t) IS NOT NULL)", lambda s, d: sel.keep_complete(pn.full_grid(panels.daily(s, d))))
register("sel_k_extremes", f"WITH {FRAME} SELECT asset FROM f GROUP BY asset ORDER BY avg(r) / stddev_samp(r) DESC, asset LIMIT 5".replace("avg(r) / stddev_samp(r)", "avg(r)"), lambda s, d: sel.keep_extremes(monthly_returns(s, d), "mean", 5))
register(
    "sel_non_expiring",
    f"WITH {RETURNS}, e AS (SELECT asset, (SELECT max(t) FROM ret) + 10 * CAST(asset AS INTEGER) AS expires FROM (SELECT DISTINCT asset FROM ret) WHERE CAST(asset AS INTEGER) < 20) SELECT a.asset FROM (SELECT DISTINCT asset FROM ret) a LEFT JOIN e USING (asset) WHERE expires IS NULL OR expires > (SELECT max(t) FROM ret) + 90",
    lambda s, d: (lambda r: sel.keep_unexpired(r, r.groupBy("asset").agg(F.max("t").alias("_t")).join(r.agg(F.max("t").alias("m"))).where("cast(asset as int) < 20").select("asset", F.expr("date_add(m, 10 * cast(asset as int))").alias("expires")), 90))(monthly_returns(s, d)),
)
register("sel_drop_correlated", None, lambda s, d: s.createDataFrame([(a,) for a in sel.keep_uncorrelated(monthly_returns(s, d), 0.3)], "asset string"))

# Splits and evaluation ----------------------------------------------------------------------------


def _months(s: SparkSession, d: str) -> int:
    return panels.monthly(s, d).select("t").distinct().count() - 1


_N = f"(WITH {RETURNS} SELECT count(DISTINCT t) FROM ret)"
WF = f"w AS (SELECT CAST(k AS INTEGER) AS split_id, 24 + 1 + 6 * k AS start FROM range(100) AS u(k) WHERE 24 + 1 + 6 * k + 6 <= {_N}), sp AS (SELECT split_id, 'train' AS role, start - 25 AS lo, start - 1 AS hi FROM w UNION ALL SELECT split_id, 'test', start, start + 6 FROM w)"
register("wf_splits", f"WITH {WF} SELECT split_id, role, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM sp", lambda s, d: sp.table(s, sp.walk_forward(_months(s, d), 6, 24, 1)))


def oos(s: SparkSession, d: str) -> DataFrame:
    """Inverse-volatility weights from each training window, held over the test window after it."""
    series = pn.indexed(monthly_returns(s, d))
    rows = sp.assign(series, sp.table(s, sp.walk_forward(_months(s, d), 6, 24, 1)))
    train = rows.where("role = 'train'").groupBy("split_id", "asset").agg((1 / F.stddev_samp("r")).alias("v"))
    weights = train.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("split_id")))
    return rows.where("role = 'test'").join(weights, ["split_id", "asset"]).groupBy("split_id", "t").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


OOS = f"{RETURNS}, ix AS (SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS i FROM ret), {WF}, tr AS (SELECT split_id, asset, 1 / stddev_samp(r) AS v FROM ix JOIN sp ON role = 'train' AND i >= lo AND i < hi GROUP BY 1, 2), ww AS (SELECT split_id, asset, v / sum(v) OVER (PARTITION BY split_id) AS weight FROM tr), o AS (SELECT split_id, ix.t, sum(weight * r) AS r FROM ix JOIN sp ON role = 'test' AND i >= lo AND i < hi JOIN ww USING (split_id, asset) GROUP BY 1, 2)"
register("wf_oos_inverse_volatility", f"WITH {OOS} SELECT split_id, {DAY}, {q8('r')} AS r FROM o", oos)
register("wf_oos_summary", f"WITH {OOS} SELECT split_id, {q8('avg(r)')} AS mean, {q8('stddev_samp(r)')} AS standard_deviation FROM o GROUP BY split_id", lambda s, d: ms.measure(oos(s, d), ["mean", "standard_deviation"], ["split_id"]))
register(
    "cpcv_paths",
    "WITH f AS (SELECT k AS f FROM range(6) AS u(k)), c AS (SELECT row_number() OVER (ORDER BY a.f, b.f) - 1 AS split_id, a.f AS x, b.f AS y FROM f a JOIN f b ON a.f < b.f), p AS (SELECT split_id, x AS fold FROM c UNION ALL SELECT split_id, y FROM c) SELECT CAST(split_id AS INTEGER) AS split_id, CAST(fold AS INTEGER) AS fold, CAST(row_number() OVER (PARTITION BY fold ORDER BY split_id) - 1 AS INTEGER) AS path_id FROM p",
    lambda s, d: s.createDataFrame(sp.combinatorial(_months(s, d), 6, 2, 1, 1)[1], "split_id int, fold int, path_id int"),
)
EVAL = OOS + ", fc AS (SELECT split_id, sum(weight * weight * s2) AS v FROM ww JOIN (SELECT split_id, asset, var_samp(r) AS s2 FROM ix JOIN sp ON role = 'train' AND i >= lo AND i < hi GROUP BY 1, 2) USING (split_id, asset) GROUP BY split_id), st AS (SELECT split_id, o.t, r, v, r / sqrt(v) AS z FROM o JOIN fc USING (split_id))"


def forecasts(s: SparkSession, d: str) -> DataFrame:
    """(split_id, t, r, v, z): out-of-sample returns with the diagonal forecast of their variance, and standardised."""
    series = pn.indexed(monthly_returns(s, d))
    rows = sp.assign(series, sp.table(s, sp.walk_forward(_months(s, d), 6, 24, 1)))
    train = rows.where("role = 'train'").groupBy("split_id", "asset").agg(F.var_samp("r").alias("s2"))
    weights = train.withColumn("v", 1 / F.sqrt("s2")).withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("split_id")))
    variance = weights.groupBy("split_id").agg(F.sum(F.col("weight") * F.col("weight") * F.col("s2")).alias("v"))
    return oos(s, d).join(variance, "split_id").withColumn("z", F.col("r") / F.sqrt("v"))


register("qlike", f"WITH {EVAL} SELECT split_id, {q8('avg(ln(v) + r * r / v)')} AS qlike FROM st GROUP BY split_id", lambda s, d: forecasts(s, d).groupBy("split_id").agg(F.avg(F.log("v") + F.col("r") * F.col("r") / F.col("v")).alias("qlike")))
register("bias_stat", f"WITH {EVAL} SELECT {q8('stddev_samp(z)')} AS bias FROM st", lambda s, d: forecasts(s, d).agg(F.stddev_samp("z").alias("bias")))
register("exceedance", f"WITH {EVAL} SELECT {q8('avg(CASE WHEN z * z > 3.841458820694124 THEN 1.0::DOUBLE ELSE 0 END)')} AS exceedance FROM st", lambda s, d: forecasts(s, d).agg(F.avg(F.when(F.col("z") * F.col("z") > 3.841458820694124, 1.0).otherwise(0.0)).alias("exceedance")))


# Dependence, priors, allocation, streams ----------------------------------------------------------

from .functions import copulas as cp  # noqa: E402
from .plans import allocation as al  # noqa: E402
from .streaming import exponential as ew  # noqa: E402

PSEUDO = RETURNS + """,
ps AS (SELECT asset, t, (rank() OVER (PARTITION BY asset ORDER BY r) + (count(*) OVER (PARTITION BY asset, r) - 1) / 2) / (count(*) OVER (PARTITION BY asset) + 1) AS u FROM ret),
uv AS (SELECT t, a.asset AS asset_i, b.asset AS asset_j, a.u, b.u AS v FROM ps a JOIN ps b USING (t) WHERE a.asset < b.asset)"""


def uv(s: SparkSession, d: str) -> DataFrame:
    """Pseudo-observations of every two assets."""
    ps = cp.pseudo_observations(monthly_returns(s, d))
    left, right = ps.select("t", F.col("asset").alias("asset_i"), "u"), ps.select("t", F.col("asset").alias("asset_j"), F.col("u").alias("v"))
    return left.join(right, "t").where("asset_i < asset_j")


register("pseudo_obs", f"WITH {PSEUDO} SELECT asset, {DAY}, {q8('u')} AS u FROM ps", lambda s, d: cp.pseudo_observations(monthly_returns(s, d)))

def both(copula, *theta) -> Callable[[], Column]:
    """The copula of columns u and v, made when a session is there."""
    return lambda: copula(F.col("u"), F.col("v"), *theta)


_COPULAS = {
    "clayton": (both(cp.clayton_cdf, 2.0), "(u ** -2.0 + v ** -2.0 - 1) ** (-1 / 2.0::DOUBLE)"),
    "gumbel": (both(cp.gumbel_cdf, 1.5), "exp(-(((-ln(u)) ** 1.5 + (-ln(v)) ** 1.5) ** (1 / 1.5::DOUBLE)))"),
    "joe": (both(cp.joe_cdf, 2.5), "1 - ((1 - u) ** 2.5 + (1 - v) ** 2.5 - (1 - u) ** 2.5 * (1 - v) ** 2.5) ** (1 / 2.5::DOUBLE)"),
    "independent": (both(cp.independent_cdf), "u * v"),
    "clayton_rotated_180": (both(lambda u, v: cp.rotated_cdf(cp.clayton_cdf, u, v, 180, 2.0)), "u + v - 1 + ((1 - u) ** -2.0 + (1 - v) ** -2.0 - 1) ** (-1 / 2.0::DOUBLE)"),
}
for _name, (_expr, _sql) in _COPULAS.items():
    register(f"copula_cdf_{_name}", f"WITH {PSEUDO} SELECT {DAY}, asset_i, asset_j, {q8(_sql)} AS c FROM uv", lambda s, d, e=_expr: uv(s, d).select("t", "asset_i", "asset_j", e().alias("c")))
register("copula_h_clayton", f"WITH {PSEUDO} SELECT {DAY}, asset_i, asset_j, {q8('(1 + v ** 2.0 * (u ** -2.0 - 1)) ** (-1.5::DOUBLE)')} AS h FROM uv", lambda s, d: uv(s, d).select("t", "asset_i", "asset_j", both(cp.clayton_h, 2.0)().alias("h")))
register("copula_log_density_clayton", f"WITH {PSEUDO} SELECT {DAY}, asset_i, asset_j, {q8('ln(3.0::DOUBLE) - 3 * (ln(u) + ln(v)) - 2.5::DOUBLE * ln(u ** -2.0 + v ** -2.0 - 1)')} AS score FROM uv", lambda s, d: uv(s, d).select("t", "asset_i", "asset_j", both(cp.clayton_log_density, 2.0)().alias("score")))
_qs = [0.1, 0.25, 0.5, 0.75, 0.9]
register("tail_concentration", f"WITH {PSEUDO}, q AS (SELECT unnest({_qs}::DOUBLE[]) AS q) SELECT asset_i, asset_j, q, {q8('coalesce(sum(CASE WHEN (q <= 0.5 AND u <= q AND v <= q) OR (q > 0.5 AND u >= q AND v >= q) THEN 1.0::DOUBLE ELSE 0 END) / nullif(sum(CASE WHEN (q <= 0.5 AND u <= q) OR (q > 0.5 AND u >= q) THEN 1.0::DOUBLE ELSE 0 END), 0), 0)')} AS concentration FROM uv, q GROUP BY asset_i, asset_j, q", lambda s, d: cp.empirical_tail_concentration(uv(s, d), _qs, ("asset_i", "asset_j")))
register(
    "mutual_info",
    f"""WITH {PAIRS}, z AS (SELECT asset_i, asset_j, least(7, floor((x - min(x) OVER k) / ((max(x) OVER k - min(x) OVER k) / 8))) AS a, least(7, floor((y - min(y) OVER k) / ((max(y) OVER k - min(y) OVER k) / 8))) AS b FROM pr WHERE asset_i < asset_j WINDOW k AS (PARTITION BY asset_i, asset_j)),
    c AS (SELECT asset_i, asset_j, a, b, count(*) AS c FROM z GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY asset_i, asset_j) AS p, sum(c) OVER (PARTITION BY asset_i, asset_j, a) / sum(c) OVER (PARTITION BY asset_i, asset_j) AS pa, sum(c) OVER (PARTITION BY asset_i, asset_j, b) / sum(c) OVER (PARTITION BY asset_i, asset_j) AS pb FROM c)
    SELECT asset_i, asset_j, {q8('1 - sum(p * ln(p / (pa * pb))) / least(-sum(p * ln(pa)), -sum(p * ln(pb)))')} AS v FROM p GROUP BY 1, 2""",
    lambda s, d: cp.mutual_information(mx.pairs(monthly_returns(s, d), "r").where("asset_i < asset_j"), 8),
)
EXPERTS = RETURNS + ", d AS (SELECT DISTINCT t FROM ret), ob AS (SELECT row_number() OVER (ORDER BY t) - 1 AS obs_idx FROM d), ex AS (SELECT obs_idx, 1.0::DOUBLE / count(*) OVER () AS p0, (obs_idx + 1) / sum(obs_idx + 1) OVER () AS p1 FROM ob)"


def experts(s: SparkSession, d: str) -> DataFrame:
    ob = pn.indexed(monthly_returns(s, d).select("t").distinct().withColumn("asset", F.lit("")))
    flat = ob.select(F.lit("flat").alias("expert"), "obs_idx", (1.0 / F.count("*").over(Window.partitionBy())).alias("p"))
    late = ob.select(F.lit("late").alias("expert"), "obs_idx", ((F.col("obs_idx") + 1) / F.sum(F.col("obs_idx") + 1).over(Window.partitionBy())).alias("p"))
    return flat.union(late)


register("opinion_pooling", f"WITH {EXPERTS} SELECT obs_idx, {q8('0.3::DOUBLE * p0 + 0.5::DOUBLE * p1 + (1 - 0.8::DOUBLE) / count(*) OVER ()')} AS p FROM ex", lambda s, d: cp.opinion_pool(experts(s, d), {"flat": 0.3, "late": 0.5}).withColumn("obs_idx", F.col("obs_idx").cast("long")))
register("opinion_pooling_geometric", f"WITH {EXPERTS}, g AS (SELECT obs_idx, exp(0.3::DOUBLE * ln(p0) + 0.5::DOUBLE * ln(p1) + (1 - 0.8::DOUBLE) * ln(1.0::DOUBLE / count(*) OVER ())) AS x FROM ex) SELECT obs_idx, {q8('x / sum(x) OVER ()')} AS p FROM g", lambda s, d: cp.opinion_pool(experts(s, d), {"flat": 0.3, "late": 0.5}, linear=False).withColumn("obs_idx", F.col("obs_idx").cast("long")))
register("ew_fold", ORACLE_SQL["ew_mu"].replace("AS mean FROM", f"AS mean, {q8(f'sum((1 - {_lam}) * pow({_lam}, k) * r * r) / (1 - pow({_lam}, count(*)))')} AS variance FROM"), lambda s, d: ew.fold(monthly_returns(s, d), 12))


def _weights(solve) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        assets, mean, cov = al.collected(monthly_returns(s, d))
        return s.createDataFrame([(a, float(w)) for a, w in zip(assets, solve(mean, cov), strict=True)], "asset string, weight double")

    return query


def shrunk(s: SparkSession, d: str) -> DataFrame:
    series = monthly_returns(s, d)
    return _weights(lambda m, c: al.shrunk_mean(m, c, series.select("t").distinct().count()))(s, d)


register("min_variance_weights", None, _weights(lambda m, c: al.minimise(c, 0 * m)))
register("max_utility_weights", None, _weights(lambda m, c: al.minimise(c, m, 5.0)))
register("risk_parity_weights", None, _weights(lambda m, c: al.risk_budgeting(c)))
register("hrp_weights", None, _weights(lambda m, c: al.hierarchical_risk_parity(c)))
register("mu_shrunk_james_stein", None, shrunk)
register("black_litterman", None, _weights(lambda m, c: al.black_litterman(c, m, np.eye(len(m))[:2] - np.eye(len(m))[2:4], np.array([0.01, 0.02]))[0]))


def frontier(s: SparkSession, d: str) -> DataFrame:
    assets, mean, cov = al.collected(monthly_returns(s, d))
    return s.createDataFrame([(k, a, float(x)) for k, w in enumerate(al.efficient_frontier(cov, mean, 5)) for a, x in zip(assets, w, strict=True)], "point int, asset string, weight double")


register("efficient_frontier", None, frontier)

from . import queries_estimators  # noqa: E402, F401
