"""Measures of return series: each an aggregate over a frame that carries what it needs.

``frame`` adds to series (key columns, t, r) only the columns that the asked measures use: the mean, the ascending rank, the
running sum's drawdown and its rank. All share one exchange on the key and differ in sorts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA = 0.95
#: Observations in a year.
YEAR = 252

c = F.col


def _below(power: int, over: Column) -> Column:
    return F.pow(F.greatest(F.lit(0.0), over - c("r")), F.lit(power))


def _tail_index(size: Column, beta: float) -> Column:
    return F.greatest(F.lit(0), F.ceil((1.0 - beta) * size) - 1)


def _at_risk(x: str, rank: str, beta: float) -> Column:
    """The order statistic at the tail's edge, without interpolation."""
    return -F.max(F.when(c(rank) == _tail_index(c("size"), beta) + 1, c(x)))


def _expected_tail(x: str, rank: str, beta: float) -> Column:
    """The mean of the tail, whose last member counts by the part of it that lies within."""
    i, k = _tail_index(c("size"), beta), (1.0 - beta) * c("size")
    inner = F.sum(F.when(c(rank) <= i, c(x) / k).otherwise(0.0))
    edge = F.sum(F.when(c(rank) == i + 1, c(x) * (i / k - 1)).otherwise(0.0))
    return -inner + edge


def _m(power: int) -> Column:
    return F.avg(F.pow(c("r") - c("mean"), F.lit(power)))


#: name -> (columns of the frame, aggregate)
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "mean": ((), lambda: F.avg("r")),
    "mean_absolute_deviation": (("mean",), lambda: F.avg(F.abs(c("r") - c("mean")))),
    "first_lower_partial_moment": (("mean",), lambda: F.avg(_below(1, c("mean")))),
    "variance": ((), lambda: F.var_samp("r")),
    "semi_variance": (("mean",), lambda: F.sum(_below(2, c("mean"))) / (F.count("r") - 1)),
    "standard_deviation": ((), lambda: F.stddev_samp("r")),
    "semi_deviation": (("mean",), lambda: F.sqrt(F.sum(_below(2, c("mean"))) / (F.count("r") - 1))),
    "third_central_moment": (("mean",), lambda: _m(3)),
    "fourth_central_moment": (("mean",), lambda: _m(4)),
    "skew": ((), lambda: F.skewness("r")),
    "kurtosis": ((), lambda: F.kurtosis("r") + 3),
    "fourth_lower_partial_moment": (("mean",), lambda: F.avg(_below(4, c("mean")))),
    "worst_realization": ((), lambda: -F.min("r")),
    "value_at_risk": (("rank",), lambda: _at_risk("r", "rank", BETA)),
    "cvar": (("rank",), lambda: _expected_tail("r", "rank", BETA)),
    "entropic_risk_measure": ((), lambda: F.log(F.avg(F.exp(-c("r"))) / (1.0 - BETA))),
    "drawdown_at_risk": (("drawdown_rank",), lambda: _at_risk("drawdown", "drawdown_rank", BETA)),
    "max_drawdown": (("drawdown",), lambda: -F.min("drawdown")),
    "average_drawdown": (("drawdown",), lambda: -F.avg("drawdown")),
    "cdar": (("drawdown_rank",), lambda: _expected_tail("drawdown", "drawdown_rank", BETA)),
    "ulcer_index": (("drawdown",), lambda: F.sqrt(F.avg(c("drawdown") * c("drawdown")))),
    "gini_mean_difference": (("rank",), lambda: F.sum((4 * c("rank") - 2 * (c("size") + 1)) / (c("size") * (c("size") - 1)) * c("r"))),
}

#: A ratio's risk, where it is not the rest of its name.
RATIO_RISK = {"sharpe_ratio": "standard_deviation", "sortino_ratio": "semi_deviation", "calmar_ratio": "max_drawdown"}
RATIOS = ("sharpe_ratio", "sortino_ratio", "calmar_ratio", "mean_absolute_deviation_ratio", "first_lower_partial_moment_ratio", "value_at_risk_ratio", "cvar_ratio", "entropic_risk_measure_ratio", "worst_realization_ratio", "drawdown_at_risk_ratio", "cdar_ratio", "average_drawdown_ratio", "ulcer_index_ratio", "gini_mean_difference_ratio")


def frame(series: DataFrame, keys: list[str], needs: Iterable[str]) -> DataFrame:
    needs = set(needs)
    out = series.where("r is not null").select(*keys, "t", "r")
    every = Window.partitionBy(*keys)
    if "mean" in needs:
        out = out.withColumn("mean", F.avg("r").over(every))
    if needs & {"rank", "drawdown_rank"}:
        out = out.withColumn("size", F.count("r").over(every))
    if "rank" in needs:
        out = out.withColumn("rank", F.row_number().over(every.orderBy("r", "t")))
    if needs & {"drawdown", "drawdown_rank"}:
        out = drawdowns(cumulative(out, keys), keys)
    if "drawdown_rank" in needs:
        out = out.withColumn("drawdown_rank", F.row_number().over(every.orderBy("drawdown", "t")))
    return out


def cumulative(series: DataFrame, keys: list[str], compounded: bool = False) -> DataFrame:
    """Running sum, or product of 1 + r; a NULL return counts as none but stays NULL."""
    over = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = F.product(1 + F.coalesce("r", F.lit(0.0))).over(over) if compounded else F.sum(F.coalesce("r", F.lit(0.0))).over(over)
    return series.withColumn("cumulative", F.when(c("r").isNotNull(), run))


def drawdowns(series: DataFrame, keys: list[str], compounded: bool = False) -> DataFrame:
    """Distance of ``cumulative`` from its running maximum, which starts at the first observation."""
    top = F.max("cumulative").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("drawdown", c("cumulative") / top - 1 if compounded else c("cumulative") - top)


def measure(series: DataFrame, names: Iterable[str], keys: list[str] | None = None) -> DataFrame:
    """One row per key with the named measures, in one aggregation."""
    keys, names = keys or ["asset"], list(names)
    full = frame(series, keys, {x for name in names for x in MEASURES[name][0]})
    return full.groupBy(*keys).agg(*(MEASURES[name][1]().alias(name) for name in names))


def ratios(series: DataFrame, names: Iterable[str] = RATIOS, keys: list[str] | None = None, risk_free: float = 0.0) -> DataFrame:
    """(mean - risk_free) over the risk of each ratio; NULL where the risk is 0."""
    keys, names = keys or ["asset"], list(names)
    risks = {name: RATIO_RISK.get(name, name.removesuffix("_ratio")) for name in names}
    base = measure(series, dict.fromkeys(["mean", *risks.values()]), keys)
    return base.select(*keys, *(F.try_divide(c("mean") - risk_free, c(risk)).alias(name) for name, risk in risks.items()))


def annualized(series: DataFrame, keys: list[str] | None = None, factor: int = YEAR) -> DataFrame:
    keys = keys or ["asset"]
    base = measure(series, ["mean", "variance", "semi_variance", "standard_deviation", "semi_deviation"], keys)
    linear, root = F.lit(factor), F.sqrt(F.lit(float(factor)))
    return base.select(*keys, *((c(x) * linear).alias(f"annualized_{x}") for x in ("mean", "variance", "semi_variance")), *((c(x) * root).alias(f"annualized_{x}") for x in ("standard_deviation", "semi_deviation")), (c("mean") * linear / (c("standard_deviation") * root)).alias("annualized_sharpe_ratio"))


def weighted_measures(series: DataFrame, keys: list[str] | None = None, beta: float = BETA) -> DataFrame:
    """Measures under observation weights ``p`` that sum to 1 per key: series (keys, t, r, p)."""
    keys = keys or ["asset"]
    every = Window.partitionBy(*keys)
    ranked = every.orderBy("r", "t")
    s = series.withColumn("mean", F.sum(c("p") * c("r")).over(every)).withColumn("upto", F.sum("p").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(ranked))
    s = s.withColumn("edge", F.min(F.when(c("upto") >= 1.0 - beta, c("rank"))).over(every))
    p, r, m = c("p"), c("r"), c("mean")
    second = F.sum(p * F.pow(r - m, F.lit(2)))
    squares = F.sum(p * p)
    inner = F.sum(F.when(c("rank") < c("edge"), p * r).otherwise(0.0)) + F.sum(F.when(c("rank") == c("edge"), r * (1.0 - beta - (c("upto") - p))).otherwise(0.0))
    at_edge = F.max(F.when(c("rank") == c("edge"), r))
    return s.groupBy(*keys).agg(
        F.sum(p * r).alias("mean"),
        F.sum(p * F.abs(r - m)).alias("mean_absolute_deviation"),
        F.sum(p * F.greatest(F.lit(0.0), m - r)).alias("first_lower_partial_moment"),
        (second / (1 - squares)).alias("variance"),
        (F.sum(p * F.pow(F.greatest(F.lit(0.0), m - r), F.lit(2))) / (1 - squares)).alias("semi_variance"),
        (F.sum(p * F.pow(r - m, F.lit(3))) / F.pow(second, F.lit(1.5))).alias("skew"),
        (F.sum(p * F.pow(r - m, F.lit(4))) / F.pow(second, F.lit(2))).alias("kurtosis"),
        (-at_edge).alias("value_at_risk"),
        F.when(F.max("edge") == 1, -F.min("r")).otherwise(-inner / (1.0 - beta)).alias("cvar"),
    )


def rolling(series: DataFrame, window: int, keys: list[str] | None = None, beta: float = BETA) -> DataFrame:
    """Measures over trailing frames of ``window`` rows, NULL until a frame is full; drawdowns start anew in each frame."""
    keys = keys or ["asset"]
    over = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - window, 0)
    full = F.count("r").over(over) == window
    held = F.collect_list("r").over(over)
    s = series.withColumn("_h", F.when(full, held)).withColumn("_s", F.array_sort("_h"))
    k = (1.0 - beta) * window
    i = max(0, -int(-k // 1) - 1)
    run = F.aggregate("_h", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.greatest(a["top"], a["sum"] + x).alias("top"), F.least(a["worst"], a["sum"] + x - F.greatest(a["top"], a["sum"] + x)).alias("worst")), lambda a: -a["worst"])
    deviation = F.stddev_samp("r").over(over)
    return s.select(
        *keys, "t",
        F.when(full, F.avg("r").over(over)).alias("mean"),
        F.when(full, deviation).alias("standard_deviation"),
        F.when(full, F.try_divide(F.avg("r").over(over), deviation)).alias("sharpe_ratio"),
        (-F.get("_s", F.lit(i))).alias("value_at_risk"),
        F.when(full, run).alias("max_drawdown"),
    )


def band(rolled: DataFrame, measure_name: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(t, p<percent>...): percentiles, over all series of a date, of a rolling measure."""
    return rolled.where(F.col(measure_name).isNotNull()).groupBy("t").agg(*(F.percentile(measure_name, q).alias(f"p{round(100 * q)}") for q in shares))
