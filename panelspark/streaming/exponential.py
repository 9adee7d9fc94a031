"""Exponentially weighted moments as a state machine: one pure step, folded in batch and kept per key in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "mean double, variance double, count long"
OUTPUT = "asset string, t timestamp, mean double, variance double, count long"


def step(state: tuple[float, float, int], r: float | None, lam: float) -> tuple[float, float, int]:
    """(mean, variance, count), uncorrected, after one observation; a missing one changes nothing."""
    if r is None or r != r:
        return state
    mean, variance, count = state
    return lam * mean + (1 - lam) * r, lam * variance + (1 - lam) * r * r, count + 1


def corrected(state: tuple[float, float, int], lam: float) -> tuple[float | None, float | None]:
    mean, variance, count = state
    bias = 1 - lam**count
    return (mean / bias, variance / bias) if count else (None, None)


def fold(series: DataFrame, half_life: float) -> DataFrame:
    """(asset, mean, variance) of a batch by the same recursion, inside the JVM: an ordered fold over each asset's dates."""
    lam = 2.0 ** (-1.0 / half_life)
    ordered = F.array_sort(F.collect_list(F.struct("t", "r")))
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"), F.lit(0).cast("long").alias("count"))

    def merge(s, x):
        r = x["r"]
        return F.when(r.isNull(), s).otherwise(F.struct((lam * s["mean"] + (1 - lam) * r).alias("mean"), (lam * s["variance"] + (1 - lam) * r * r).alias("variance"), (s["count"] + 1).alias("count")))

    s = series.groupBy("asset").agg(F.aggregate(ordered, start, merge).alias("s"))
    bias = 1 - F.pow(F.lit(lam), F.col("s.count").cast("double"))
    return s.select("asset", F.try_divide(F.col("s.mean"), bias).alias("mean"), F.try_divide(F.col("s.variance"), bias).alias("variance"))


def search_half_life(series: DataFrame, half_lives: list[float], warmup: int = 12) -> DataFrame:
    """(asset, half_life, score, n, best): each candidate's forecasts of the variance, made before every date from those earlier, scored by mean QLIKE.

    Dates count from the ``warmup``-th known return on. The lowest score is ``best``, ties by the shorter half-life. One ordered fold an asset and candidate,
    inside the JVM.
    """
    rows = series.where("r is not null").groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("t", "r"))).alias("s"))
    rows = rows.withColumn("half_life", F.explode(F.array(*(F.lit(float(h)) for h in half_lives)))).withColumn("lam", F.pow(F.lit(2.0), -1 / F.col("half_life")))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("v"), F.lit(0).alias("k"), zero.alias("loss"), F.lit(0).alias("n"))

    def merge(s, x):
        square = x["r"] * x["r"]
        ready = (s["k"] >= warmup) & (s["v"] > 0)
        v = s["v"] / (1 - F.pow("lam", s["k"].cast("double")))
        return F.struct(
            (F.col("lam") * s["v"] + (1 - F.col("lam")) * square).alias("v"),
            (s["k"] + 1).alias("k"),
            (s["loss"] + F.when(ready, F.log(v) + square / v).otherwise(0.0)).alias("loss"),
            (s["n"] + F.when(ready, 1).otherwise(0)).alias("n"),
        )

    found = rows.select("asset", "half_life", F.aggregate("s", start, merge).alias("s")).where("s.n > 0").select("asset", "half_life", (F.col("s.loss") / F.col("s.n")).alias("score"), F.col("s.n").alias("n"))
    return found.withColumn("best", F.row_number().over(Window.partitionBy("asset").orderBy("score", "half_life")) == 1)


class Exponential(StatefulProcessor):
    """Keeps the state of each asset; rows of a micro-batch are taken in order of t."""

    def __init__(self, half_life: float) -> None:
        self.lam = 2.0 ** (-1.0 / half_life)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else (0.0, 0.0, 0)
        out = []
        for t, r in pd.concat(list(rows)).sort_values("t")[["t", "r"]].itertuples(index=False):
            state = step(state, r, self.lam)
            out.append((key[0], t, *corrected(state, self.lam), state[2]))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["asset", "t", "mean", "variance", "count"])

    def close(self) -> None:
        pass


def stream(series: DataFrame, half_life: float) -> DataFrame:
    """A streaming (asset, t, r) as its running moments. The session needs the RocksDB state store."""
    series.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return series.groupBy("asset").transformWithStateInPandas(Exponential(half_life), OUTPUT, "Append", "None")
