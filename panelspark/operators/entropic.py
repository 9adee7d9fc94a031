"""Entropic risks at a level: the least over z of z * log(mean(exp(loss / z)) / (1 - beta)).

The function has one minimum, so its place is bracketed on a grid of z that narrows around the best point; a
round is one aggregation of the whole series, however many keys it has, and keeps one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from . import measures

#: Points of the grid, rounds, decades that the first grid spans above the largest loss over ``GUARD``.
POINTS, ROUNDS, DECADES, GUARD = 17, 7, 5.0, 100.0


def entropic_at_risk(losses: DataFrame, keys: list[str], beta: float = 0.95) -> DataFrame:
    """(keys, value) of losses (keys, loss). z is at least a hundredth of the largest absolute loss, so that no power overflows; null losses are left out."""
    rows = losses.where("loss is not null").select(*keys, "loss")
    state = rows.groupBy(*keys).agg(F.max("loss").alias("top"), F.greatest(F.max(F.abs("loss")), F.lit(1e-12)).alias("size"))
    state = cut(state.select(*keys, "top", F.log(F.col("size") / GUARD).alias("low"), F.log(F.col("size") / GUARD * 10**DECADES).alias("high")), "entropic")
    at = lambda k: F.exp(F.col("low") + (F.col("high") - F.col("low")) * (k / (POINTS - 1)))
    for _ in range(ROUNDS):
        sums = [F.avg(F.exp((F.col("loss") - F.col("top")) / at(k))).alias(f"m{k}") for k in range(POINTS)]
        met = rows.join(state, keys).groupBy(*keys, "top", "low", "high").agg(*sums)
        every = F.array(*(F.struct((F.col("top") + at(k) * F.log(F.col(f"m{k}") / (1 - beta))).alias("value"), F.lit(k).alias("k")) for k in range(POINTS)))
        met = met.withColumn("best", F.array_min(every))
        step = (F.col("high") - F.col("low")) / (POINTS - 1)
        low = F.col("low") + step * F.greatest(F.col("best.k") - 1, F.lit(0))
        high = F.col("low") + step * F.least(F.col("best.k") + 1, F.lit(POINTS - 1))
        state = cut(met.select(*keys, "top", low.alias("low"), high.alias("high"), F.col("best.value").alias("value")), "entropic")
    return state.select(*keys, "value")


def evar(series: DataFrame, keys: list[str] | None = None, beta: float = 0.95) -> DataFrame:
    """(keys, evar) of returns (keys, r)."""
    keys = keys or ["asset"]
    return entropic_at_risk(series.withColumn("loss", -F.col("r")), keys, beta).withColumnRenamed("value", "evar")


def edar(series: DataFrame, keys: list[str] | None = None, beta: float = 0.95) -> DataFrame:
    """(keys, edar): the same of drawdowns of the running sum."""
    keys = keys or ["asset"]
    falls = measures.drawdowns(measures.cumulative(series, keys), keys)
    return entropic_at_risk(falls.withColumn("loss", -F.col("drawdown")), keys, beta).withColumnRenamed("value", "edar")


def entropic_ratios(series: DataFrame, keys: list[str] | None = None, beta: float = 0.95) -> DataFrame:
    """(keys, evar_ratio, edar_ratio): the mean over either risk, NULL where it is 0."""
    keys = keys or ["asset"]
    every = measures.measure(series, ["mean"], keys).join(evar(series, keys, beta), keys).join(edar(series, keys, beta), keys)
    return every.select(*keys, F.try_divide("mean", "evar").alias("evar_ratio"), F.try_divide("mean", "edar").alias("edar_ratio"))
