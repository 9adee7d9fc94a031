"""Uncertainty sets, Schur-complementary weights, tracking, fallbacks, regressions, files: against plain versions."""

import datetime as dt
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cross_section as cs
from panelspark.operators import matrices as mx
from panelspark.operators import portfolios as pf
from panelspark.plans import allocation as al
from panelspark.plans import risk
from panelspark.plans import uncertainty as un
from panelspark.sources import panels


@pytest.fixture
def returns():
    rng = np.random.default_rng(3)
    return rng.normal(0.001, 0.01, (150, 8)) + 0.8 * rng.normal(0, 0.01, (150, 1))


def long(spark, x):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(i), i, f"a{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "t timestamp, obs_idx int, asset string, r double")


def test_chi_squared_quantiles():
    # Published tables of the 95 % quantile for 1, 10 and 100 degrees of freedom.
    assert [un.chi2_quantile(0.95, k) for k in (1, 10, 100)] == pytest.approx([3.841458820694124, 18.307038053275146, 124.34211340400407], rel=1e-9)
    assert un.radius(2) == pytest.approx(np.sqrt(-2 * np.log(0.05))) and un.radius(2, of_covariance=True) > un.radius(2)


def test_weights_carried_between_neighbours():
    for n, m in ((3, 2), (2, 3), (4, 4), (5, 4), (1, 2)):
        s = al._spread(n, m)
        assert s.shape == (n, m) and np.allclose(s.sum(axis=1), 1)
    assert np.allclose(al._spread(2, 1), 1)


def test_schur_goes_from_hierarchical_to_least_variance(returns):
    cov = np.cov(returns.T)
    w, g = al.schur_complementary(cov, 0.0)
    assert g == 0 and np.allclose(w, al.hierarchical_risk_parity(cov))
    risks = [(lambda v: v @ cov @ v)(al.schur_complementary(cov, g)[0]) for g in (0.0, 0.3, 0.6)]
    assert risks == sorted(risks, reverse=True) and risks[-1] >= (lambda v: v @ cov @ v)(al.minimise(cov, np.zeros(8))) - 1e-12
    with pytest.raises(al.OptimizationError):
        al.schur_complementary(np.array([[1, 0.99, 0.99, -0.9], [0.99, 1, 0.99, -0.9], [0.99, 0.99, 1, -0.9], [-0.9, -0.9, -0.9, 1.0]]) - 0.2 * np.eye(4), 1.0, monotonic=False)


def test_tracking_finds_the_benchmark(returns):
    w = np.array([0.4, 0.3, 0.2, 0.1, 0, 0, 0, 0])
    assert np.allclose(risk.track(returns, returns @ w), w, atol=1e-4)
    assert np.allclose(risk.track(returns, returns @ w, "cvar"), w, atol=1e-3)


def test_maximum_diversification(returns):
    cov = np.cov(returns.T)
    sd = np.sqrt(np.diag(cov))
    ratio = lambda w: w @ sd / np.sqrt(w @ cov @ w)
    best = ratio(al.maximum_diversification(cov))
    rng = np.random.default_rng(0)
    assert all(ratio(v) <= best + 1e-9 for v in rng.dirichlet(np.ones(8), 2000))


def test_fallbacks_in_turn(spark, returns, monkeypatch):
    def fails(x):
        raise al.OptimizationError

    series = long(spark, returns).select("t", "asset", "r", F.lit("broken").alias("allocator"))
    monkeypatch.setitem(risk.ALLOCATORS, "broken", fails)
    got = risk.allocate(series, [], fallback=("broken", "equal")).collect()
    assert {(round(r["weight"], 9), r["failed"]) for r in got} == {(0.125, True)}
    assert {r["weight"] for r in risk.allocate(series, [], fallback=None).collect()} == {None}


def test_sets_against_numpy(spark, returns):
    panel, n = long(spark, returns), len(returns)
    cov = np.cov(returns.T)
    got = {(r["asset_i"], r["asset_j"]): r["v"] for r in un.covariance_set(panel, diagonal=False).collect()}
    s = cov / n
    k = np.zeros((64, 64))  # turns the entries of a matrix, column by column, into those of its transpose
    for i in range(8):
        for j in range(8):
            k[i * 8 + j, j * 8 + i] = 1
    want = np.diag(n * (np.eye(64) + k) @ np.kron(s, s)).reshape(8, 8)
    assert all(got[(f"a{i}", f"a{j}")] == pytest.approx(want[i, j]) for i in range(8) for j in range(8))
    boot = {r["asset_i"]: r["v"] for r in un.bootstrap_mean_set(panel, 300, 1.0).collect()}
    assert all(boot[f"a{i}"] == pytest.approx(cov[i, i] / n, rel=0.4) for i in range(8))
    assert un.mean_set(panel).count() == 8 and un.bootstrap_covariance_set(panel, 10, 5.0).count() == 64


def test_block_length_grows_with_memory():
    rng = np.random.default_rng(4)
    e = rng.normal(size=2000)
    x = np.zeros(2000)
    for i in range(1, 2000):
        x[i] = 0.8 * x[i - 1] + e[i]
    assert un.block_length(e) < 6 < un.block_length(x) <= np.ceil(3 * np.sqrt(2000))
    assert un.block_length(np.zeros(50)) == 1.0


def test_implied_covariance_against_numpy(spark, returns):
    rng = np.random.default_rng(9)
    vols = 0.2 + 0.05 * rng.random(returns.shape)
    panel = long(spark, returns)
    got = {(r["asset_i"], r["asset_j"]): r["v"] for r in mx.implied_covariance(panel, long(spark, vols).withColumnRenamed("r", "vol"), 20).collect()}
    x = returns[-140:].reshape(7, 20, 8)
    rv, iv = np.log(x.std(axis=1, ddof=1)), np.log(vols[9 + 20 :: 20] / np.sqrt(252))
    pred = []
    for j in range(8):
        a = np.column_stack([np.ones(6), iv[:-1, j], rv[:-1, j]])
        b = np.linalg.lstsq(a, rv[1:, j], rcond=None)[0]
        pred.append(np.exp(b @ [1, iv[-1, j], rv[-1, j]]))
    want = np.corrcoef(returns.T) * np.outer(pred, pred)
    assert all(got[(f"a{i}", f"a{j}")] == pytest.approx(want[i, j], rel=1e-6) for i in range(8) for j in range(8))


def test_several_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    y, w = x @ [1.0, -2.0, 0.5] + 0.3 + 0.1 * rng.normal(size=40), rng.random(40) + 0.1
    rows = [("t", f"a{i}", *map(float, x[i]), float(y[i]), float(w[i])) for i in range(40)] + [("u", "a", None, 1.0, 1.0, 1.0, 1.0)]
    data = spark.createDataFrame(rows, "t string, asset string, p double, q double, s double, y double, w double")
    (got,) = cs.regression_on(data, ["p", "q", "s"]).collect()
    root = np.sqrt(w)
    want = np.linalg.lstsq(np.column_stack([np.ones(40), x]) * root[:, None], y * root, rcond=None)[0]
    assert [got["intercept"], got["b_p"], got["b_q"], got["b_s"]] == pytest.approx(want)


def test_files_and_periods(spark, tmp_path):
    with gzip.open(tmp_path / "prices.csv.gz", "wt") as f:
        f.write("Date,A,B\n2020-01-01,1.5,2\n2020-01-02,,2.5\n")
    panel = panels.read_panel_csv(spark, str(tmp_path / "prices.csv.gz"))
    assert sorted((r["asset"], str(r["t"])[:10], r["price"]) for r in panel.collect() if r["price"]) == [("A", "2020-01-01", 1.5), ("B", "2020-01-01", 2.0), ("B", "2020-01-02", 2.5)]
    panels.write_panel(panel, str(tmp_path / "panel"))
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 4
    periods = spark.createDataFrame([("p", 0, 1, 0.1), ("p", 0, 2, 0.2), ("p", 1, 3, 0.3), ("q", 0, 5, 0.1), ("q", 1, 4, 0.2)], "portfolio_id string, period_id int, t int, r double")
    assert {(r["portfolio_id"], r["period_id"]): r["in_order"] for r in pf.multi_period(periods).collect()} == {("p", 0): True, ("p", 1): True, ("q", 0): True, ("q", 1): False}
