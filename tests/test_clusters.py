"""Clusters, spectra, calendar splits, resamples and normal copulas, against plain versions."""

import datetime as dt
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import copulas as cp
from panelspark.operators import spectra
from panelspark.plans import clusters as cl
from panelspark.plans import splits as sp
from panelspark.plans.allocation import OptimizationError, linkage


@pytest.fixture
def groups():
    """Three groups of assets that each follow a factor of their own."""
    rng = np.random.default_rng(5)
    factor = rng.normal(0, 0.02, (300, 3))
    return np.repeat(factor, 4, axis=1) + rng.normal(0, 0.006, (300, 12))


def test_clusters_are_found(groups):
    d = cl.correlation_distance(groups)
    merges = linkage(d)
    assert cl.best_count(d, merges) == 3
    assert cl.cut(merges, 3) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert cl.cut(merges, 1) == [list(range(12))] and cl.cut(merges, 12) == [[i] for i in range(12)]


def test_equal_risk_contribution_by_hand(groups):
    w = cl.equal_risk_contribution(groups)
    parts, risk = [list(range(0, 4)), list(range(4, 8)), list(range(8, 12))], []
    inner = np.zeros(12)
    for p in parts:
        v = 1 / groups[:, p].var(axis=0, ddof=1)
        inner[p] = v / v.sum()
        risk.append((groups[:, p] @ inner[p]).var(ddof=1))
    a, b, _, _ = linkage(cl.correlation_distance(groups))[-2]  # the fork below the root joins two of the groups
    leaves = lambda node: {node} if node < 12 else leaves(linkage(cl.correlation_distance(groups))[node - 12][0]) | leaves(linkage(cl.correlation_distance(groups))[node - 12][1])
    x, y = (next(i for i, p in enumerate(parts) if set(p) == leaves(n)) for n in (a, b))
    z = 3 - x - y
    share = np.zeros(3)
    pair = risk[x] + risk[y]
    share[z] = pair / (pair + risk[z])
    share[x], share[y] = (1 - share[z]) * risk[y] / pair, (1 - share[z]) * risk[x] / pair
    assert np.allclose(w, inner * np.repeat(share, 4), rtol=1e-9)


def test_bounds_keep_relative_changes_least():
    w = cl.within(np.array([0.7, 0.2, 0.1]), 0.15, 0.6)
    assert w.sum() == pytest.approx(1) and w.min() >= 0.15 and w.max() <= 0.6
    assert np.array_equal(cl.within(np.array([0.5, 0.5])), [0.5, 0.5])
    free = cl.within(np.array([0.7, 0.2, 0.1]), 0.0, 0.6) - [0.7, 0.2, 0.1]
    assert free[1] / 0.2**2 == pytest.approx(free[2] / 0.1**2)
    with pytest.raises(OptimizationError):
        cl.within(np.array([0.5, 0.5]), 0.0, 0.4)


@pytest.mark.parametrize("folds", [None, 5])
def test_nested_weights(groups, folds):
    equal = lambda x: np.full(x.shape[1], 1 / x.shape[1])
    assert np.allclose(cl.nested(groups, equal, equal, folds), 1 / 12)
    assert np.allclose(cl.nested(groups[:, :1], equal, equal, folds), 1)


def test_noise_is_levelled_and_the_market_goes():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 20)) + 0.6 * rng.normal(0, 1, (400, 1))
    cov = np.cov(x.T)
    for cleaned in (spectra.denoised(cov, 400), spectra.detoned(cov)):
        assert np.allclose(np.diag(cleaned), np.diag(cov)) and np.allclose(cleaned, cleaned.T)
    values = np.linalg.eigvalsh(spectra.denoised(cov, 400))
    assert values.min() > np.linalg.eigvalsh(cov).min() and values.max() > 3
    off = lambda c: (c - np.diag(np.diag(c))).mean()
    assert abs(off(spectra.detoned(cov))) < off(cov) / 3


def _frame(spark, days):
    return spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), i) for i, t in enumerate(days)], "t timestamp, obs_idx int")


def test_calendar_splits_against_pandas(spark):
    days = pd.bdate_range("2020-01-15", "2021-03-10")
    got = {(r["split_id"], r["role"]): (r["lo"], r["hi"]) for r in sp.calendar_walk_forward(_frame(spark, days), 1, 3, "month", purge=2).collect()}
    at = [days.searchsorted(b) for b in pd.date_range(days[0], days[-1], freq="MS")]
    want = {}
    for i in range(len(at) - 4):
        want[(i, "train")], want[(i, "test")] = (at[i], at[i + 3] - 2), (at[i + 3], at[i + 4])
    assert got == want
    whole = sp.calendar_walk_forward(_frame(spark, days), 2, "90 DAYS", "month", previous=True, purge=1, expand=True, reduce_test=True).collect()
    assert max(r["hi"] for r in whole if r["role"] == "test") == len(days)
    assert {r["lo"] for r in whole if r["role"] == "train"} == {0}
    starts = [b for b in pd.date_range(days[0], days[-1], freq="MS") if b - pd.Timedelta("90D") >= days[0]][::2]
    assert sorted(r["lo"] for r in whole if r["role"] == "test") == [days.searchsorted(b, side="right") - 1 for b in starts]
    assert sp.calendar_walk_forward(_frame(spark, []), 1, 3).count() == 0


def test_randomized_paths():
    ranges, of, members = sp.multiple_randomized(100, list("abcd"), 6, 2, 5, 20, 0, 50, seed=1)
    sets = {p: {a for q, a in members if q == p} for p in range(6)}
    assert len({frozenset(s) for s in sets.values()}) == 6 and all(len(s) == 2 for s in sets.values())
    assert len(of) == 36 and all(0 <= lo < hi <= 100 for _, _, lo, hi in ranges)
    assert sp.multiple_randomized(100, list("abcd"), 6, 2, 5, 20, 0, 50, seed=1) == (ranges, of, members)
    with pytest.raises(ValueError):
        sp.multiple_randomized(100, list("abcd"), 7, 2, 5, 20)


def test_bootstrap_runs_have_the_mean_length(spark):
    panel = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(i), i, "a", float(i)) for i in range(200)], "t timestamp, obs_idx int, asset string, r double")
    rows = sp.stationary_bootstrap(panel, 50, 8.0, seed=3).toPandas().sort_values(["sample_id", "place"])
    steps = rows.groupby("sample_id")["r"].diff().dropna()
    assert len(rows) == 50 * 200 and abs((steps.isin([1, -199])).mean() - 7 / 8) < 0.02
    assert abs(rows["r"].mean() - 99.5) < 8
    assert sp.stationary_bootstrap(panel.where("false"), 5, 8.0).count() == 0


def test_resamples_hold_the_panels_returns_whose_last_bits_vary(spark, monkeypatch):
    """Every reading of the panel adds in another order, as shuffled sums do."""
    from panelspark import queries_estimators as qe
    from panelspark.queries import QUERIES

    @F.pandas_udf("double")
    def summed(x: pd.Series) -> pd.Series:
        return x + np.random.default_rng().uniform(0, 1e-12, len(x))

    panel = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), a, 0.01 * i) for i in range(30) for a in "ab"], "t date, asset string, x double")
    monkeypatch.setattr(qe, "monthly_returns", lambda s, d: panel.select("t", "asset", summed.asNondeterministic()("x").alias("r")))
    got = QUERIES["bootstrap_stationary"](spark, "").collect()
    assert len(got) == 20 and all(r["places"] == 30 and r["known"] for r in got)


def test_normal_copula(spark):
    u = spark.createDataFrame([(0.2, 0.7), (0.9, 0.85), (0.5, 0.01)], "u double, v double")
    from pyspark.sql import functions as F

    n = statistics.NormalDist()
    h = cp.gaussian_h(F.col("u"), F.col("v"), 0.6)
    for r in u.withColumn("h", h).withColumn("back", cp.gaussian_inverse_h(F.col("h"), F.col("v"), 0.6)).collect():
        x, y = n.inv_cdf(r["u"]), n.inv_cdf(r["v"])
        assert r["h"] == pytest.approx(n.cdf((x - 0.6 * y) / 0.8), rel=1e-9)
        assert r["back"] == pytest.approx(r["u"], rel=1e-8)


@pytest.mark.parametrize("density, theta", [(cp.clayton_log_density, 2.0), (cp.gumbel_log_density, 1.7), (cp.joe_log_density, 2.2)])
def test_densities_are_the_second_derivatives(spark, density, theta):
    from pyspark.sql import functions as F

    cdf = {cp.clayton_log_density: cp.clayton_cdf, cp.gumbel_log_density: cp.gumbel_cdf, cp.joe_log_density: cp.joe_cdf}[density]
    e, u, v = 1e-4, F.col("u"), F.col("v")
    mixed = (cdf(u + e, v + e, theta) - cdf(u + e, v - e, theta) - cdf(u - e, v + e, theta) + cdf(u - e, v - e, theta)) / (4 * e * e)
    points = spark.createDataFrame([(0.3, 0.4), (0.8, 0.6), (0.55, 0.9)], "u double, v double")
    for r in points.select(F.exp(density(u, v, theta)).alias("a"), mixed.alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], rel=1e-4)


def test_the_family_that_made_the_pairs_is_selected(spark):
    rng = np.random.default_rng(2)
    v, p = rng.random((2, 3000))
    clayton = (1 + v**-2.0 * (p ** (-2.0 / 3) - 1)) ** -0.5
    rows = [("a", "b", float(x), float(y)) for x, y in zip(clayton, v, strict=True)] + [("a", "c", float(1 - x), float(y)) for x, y in zip(clayton, v, strict=True)]
    rows += [("a", "d", float(x), float(y)) for x, y in zip(p, v, strict=True)]
    pairs = spark.createDataFrame(rows, "asset_i string, asset_j string, u double, v double")
    taus = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.5), ("a", "d", 0.002), ("a", "e", None)], "asset_i string, asset_j string, tau double")
    got = {r["asset_j"]: (r["family"], r["degrees"]) for r in cp.select_copula(pairs, taus).collect()}
    assert got == {"b": ("clayton", 0), "c": ("clayton", 90), "d": ("independent", 0)}
