"""Evaluation splits as range tables (split_id, path_id, role, lo, hi), to be joined to obs_idx; they depend on counts alone."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "split_id int, role string, lo long, hi long"


def walk_forward(n: int, test: int, train: int, purge: int = 0, expand: bool = False, reduce_test: bool = False) -> list[tuple[int, str, int, int]]:
    """Training windows with test windows after them; the last ``purge`` rows of a training window go. Ranges hold their ends' low, not their high."""
    if train + purge >= n:
        raise ValueError("the training window and the purge leave nothing to test")
    out, k = [], 0
    start = train + purge
    while start < n and (start + test <= n or reduce_test):
        low = 0 if expand else start - train - purge
        out += [(k, "train", low, start - purge), (k, "test", start, min(start + test, n))]
        k, start = k + 1, start + test
    return out


def combinatorial(n: int, folds: int, tests: int, purge: int = 0, embargo: int = 0) -> tuple[list[tuple[int, str, int, int]], list[tuple[int, int, int]]]:
    """(ranges, (split_id, fold, path_id)): every choice of ``tests`` of the folds as test set, and the paths that the test folds form.

    A fold has n // folds rows; rows beyond all folds belong to the last as far as one more fold's rows, and
    to training alone beyond that. Training leaves out ``purge`` rows on both sides of a test fold and
    ``embargo`` more after it.
    """
    size = n // folds
    bounds = [(f * size, (f + 1) * size if f < folds - 1 else min((folds + 1) * size, n)) for f in range(folds)]
    ranges, paths, used = [], [], [0] * folds
    for k, chosen in enumerate(combinations(range(folds), tests)):
        low = 0
        for f in chosen:
            a, b = bounds[f]
            ranges.append((k, "test", a, b))
            if low < a - purge:
                ranges.append((k, "train", low, a - purge))
            low = max(low, b + purge + embargo)
            paths.append((k, f, used[f]))
            used[f] += 1
        if low < n:
            ranges.append((k, "train", low, n))
    return ranges, paths


def n_combinatorial_paths(folds: int, tests: int) -> int:
    return comb(folds, tests) * tests // folds


def combination_by_index(index: int, n: int, k: int) -> tuple[int, ...]:
    """The combination at a place of the lexicographic order, without listing those before it."""
    out, low = [], 0
    while k:
        here = comb(n - low - 1, k - 1)
        if index < here:
            out.append(low)
            k -= 1
        else:
            index -= here
        low += 1
    return tuple(out)


def table(spark: SparkSession, ranges: list[tuple[int, str, int, int]]) -> DataFrame:
    return spark.createDataFrame(ranges, SCHEMA)


def assign(indexed: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of an indexed panel with the splits and roles whose ranges hold them: ranges become rows of the index, so the join is by equality."""
    rows = splits.where("hi > lo").select("split_id", "role", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("obs_idx"))
    return indexed.join(rows, "obs_idx")


def _as_of(dates: DataFrame, points: DataFrame, previous: bool) -> DataFrame:
    """(k, idx): for every point in time (k, at), the first date's index from it on, or with ``previous`` the last one's up to it; none, no row."""
    marks = dates.select("t", "obs_idx", F.lit(None).cast("int").alias("k")).unionByName(points.select(F.col("at").alias("t"), F.lit(None).cast("int").alias("obs_idx"), "k"))
    over = Window.orderBy("t")
    back, on = over.rangeBetween(Window.unboundedPreceding, Window.currentRow), over.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    idx = F.max("obs_idx").over(back) if previous else F.min("obs_idx").over(on)
    return marks.withColumn("idx", idx).where("k is not null and idx is not null").select("k", "idx")


def calendar_walk_forward(
    indexed: DataFrame, test: int, train: int | str, unit: str = "month", offset: str | None = None, previous: bool = False, purge: int = 0, expand: bool = False, reduce_test: bool = False
) -> DataFrame:
    """Split ranges whose bounds are starts of a calendar ``unit`` (week, month, quarter, year), moved by ``offset`` (an interval as SQL has it).

    ``indexed`` has t and obs_idx. A bound stands for the first date from it on (with ``previous``, the last up to it); bounds
    outside the dates are dropped. Test windows last ``test`` units. Training lasts ``train`` units, less ``purge`` rows at its end; or, if
    ``train`` is an interval, goes back that far from the test's start, and then ``purge`` rows go from the end of the test.
    """
    dates = indexed.select(F.col("t").cast("timestamp").alias("t"), F.col("obs_idx").cast("int").alias("obs_idx")).distinct()
    moved = (lambda c: c + F.expr(f"INTERVAL {offset}")) if offset else (lambda c: c)
    back = (lambda c: F.least(c, c - F.expr(f"INTERVAL {offset}"))) if offset else (lambda c: c)
    span = dates.agg(F.min("t").alias("first"), F.max("t").alias("last"), (F.max("obs_idx") + 1).alias("n")).withColumn("start", back(F.col("first")))
    floor = F.date_trunc(unit, F.col("start"))
    each = F.expr({"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}[unit])
    span = span.withColumn("opening", F.when(floor < F.col("start"), floor + each).otherwise(floor)).where("opening <= last")
    bounds = span.select("last", F.posexplode(F.sequence("opening", "last", each)).alias("k", "b")).select("k", moved(F.col("b")).alias("at"), "last").where("at <= last").select("k", "at")
    at = _as_of(dates, bounds, previous)
    order = Window.orderBy("k")
    if isinstance(train, int):
        found = at.withColumn("k", F.row_number().over(order) - 1).withColumn("begin", F.lead("idx", train).over(order)).withColumn("end", F.lead("idx", train + test).over(order))
        found = found.withColumn("train_lo", F.col("idx")).withColumn("train_hi", F.col("begin") - purge)
    else:
        lows = _as_of(dates, bounds.withColumn("at", F.col("at") - F.expr(f"INTERVAL {train}")), True).select("k", F.col("idx").alias("train_lo"))
        found = at.join(lows, "k").withColumn("begin", F.col("idx")).withColumn("k", F.row_number().over(order) - 1).withColumn("end", F.lead("idx", test).over(order) - purge).withColumn("train_hi", F.col("begin"))
    found = found.join(span.select("n")).where((F.col("k") % test == 0) & F.col("begin").isNotNull())
    found = found.withColumn("end", F.coalesce("end", "n")) if reduce_test else found.where("end is not null")
    low = F.lit(0) if expand else F.col("train_lo")
    ranges = F.array(F.struct(F.lit("train").alias("role"), low.alias("lo"), F.col("train_hi").alias("hi")), F.struct(F.lit("test").alias("role"), F.col("begin").alias("lo"), F.col("end").alias("hi")))
    out = found.select((F.col("k") / test).cast("int").alias("split_id"), F.explode(ranges).alias("s"))
    return out.select("split_id", "s.role", F.col("s.lo").cast("long").alias("lo"), F.col("s.hi").cast("long").alias("hi"))


def multiple_randomized(n: int, assets: list[str], paths: int, size: int, test: int, train: int, purge: int = 0, window: int | None = None, seed: int = 0) -> tuple[list[tuple[int, str, int, int]], list[tuple[int, int]], list[tuple[int, str]]]:
    """(ranges, (split_id, path_id), (path_id, asset)): for every path a different random subset of ``size`` assets, a random run of
    ``window`` rows (all without one) and the walk forward inside it. Repeats with the seed.
    """
    most = comb(len(assets), size)
    if not 1 <= size <= len(assets) or not 2 <= paths <= most:
        raise ValueError("there are not as many different subsets")
    if window is not None and not 2 <= window <= n:
        raise ValueError("the window does not fit the rows")
    rng = np.random.default_rng(seed)
    chosen: dict[tuple[int, ...], None] = {}
    while len(chosen) < paths:
        # Many subsets: draws hardly ever repeat. Few: places of the list of all, without repeats.
        if most > 4 * paths:
            chosen[tuple(sorted(int(i) for i in rng.choice(len(assets), size, replace=False)))] = None
        else:
            chosen = {combination_by_index(int(i), len(assets), size): None for i in rng.permutation(most)[:paths]}
    ranges, of, members = [], [], []
    for path, subset in enumerate(chosen):
        start = 0 if window is None else int(rng.integers(0, n - window + 1))
        inner = walk_forward(n if window is None else window, test, train, purge)
        first = len(of)
        of += [(first + k, path) for k in sorted({r[0] for r in inner})]
        ranges += [(first + k, role, lo + start, hi + start) for k, role, lo, hi in inner]
        members += [(path, assets[i]) for i in subset]
    return ranges, of, members


def stationary_bootstrap(indexed: DataFrame, samples: int, block: float, seed: int = 0) -> DataFrame:
    """(sample_id, place, t, asset, r): ``samples`` resamples of all dates in runs of geometric length with mean ``block``, past the end from the first.

    Runs begin at every place with probability 1 / block. Draws are hashes of seed, sample and place, so reruns and retried tasks agree. A
    sample's places are one task's numbers; returns join by index.
    """
    n = indexed.agg(F.max("obs_idx")).first()[0]
    if n is None:
        return indexed.select(F.lit(0).alias("sample_id"), F.lit(0).alias("place"), "t", "asset", "r").where("false")
    n += 1
    spark = indexed.sparkSession
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "sample_id", "place"), F.lit(1 << 53))
    rows = spark.range(samples).select(F.col("id").cast("int").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    fresh = (F.col("place") == 0) | (draw("run") < F.lit(int((1 << 53) / block)))
    rows = rows.withColumn("begun", F.when(fresh, F.struct("place", F.pmod(draw("start"), F.lit(n)).alias("at"))))
    rows = rows.withColumn("begun", F.last("begun", ignorenulls=True).over(Window.partitionBy("sample_id").orderBy("place")))
    rows = rows.select("sample_id", "place", F.pmod(F.col("begun.at") + F.col("place") - F.col("begun.place"), F.lit(n)).cast("int").alias("obs_idx"))
    return rows.join(indexed.select(F.col("obs_idx").cast("int").alias("obs_idx"), "t", "asset", "r"), "obs_idx").drop("obs_idx").select("sample_id", "place", "t", "asset", "r")
