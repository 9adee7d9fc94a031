"""Solvers, trees, counts and equations against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import forecasts, matrices, portfolios
from panelspark.plans import allocation, equations, priors, risk


@pytest.fixture(scope="module")
def returns():
    return np.random.default_rng(0).normal(0.01, 0.05, (60, 6)) * np.linspace(0.5, 2, 6)


def value(w, x, kind, beta=0.95):
    r = x @ w
    top = np.maximum.accumulate(np.cumsum(r)) - np.cumsum(r)
    tail = lambda loss: min(a + np.maximum(loss - a, 0).sum() / ((1 - beta) * len(loss)) for a in loss)
    below = np.maximum(r.mean() - r, 0)
    return {
        "variance": r.var(ddof=1), "semi_variance": (below**2).sum() / (len(r) - 1), "mean_absolute_deviation": np.abs(r - r.mean()).mean(),
        "first_lower_partial_moment": below.mean(), "cvar": tail(-r), "worst_realization": -r.min(), "max_drawdown": top.max(),
        "average_drawdown": top.mean(), "cdar": tail(top), "ulcer_index": np.sqrt((top**2).mean()),
    }[kind]


@pytest.mark.parametrize("kind", risk.RISKS)
def test_no_step_towards_any_vertex_lowers_the_least_risk(returns, kind):
    w = risk.mean_risk(returns, kind)
    assert w.sum() == pytest.approx(1) and w.min() > -1e-8
    best = value(w, returns, kind)
    others = [*np.eye(6), *np.random.default_rng(1).dirichlet(np.ones(6), 50)]
    assert all(value((1 - e) * w + e * o, returns, kind) >= best - 1e-7 for o in others for e in (0.02, 0.3, 1.0))


def test_bounds_costs_turnover_floor_rows_and_objectives(returns):
    old = np.full(6, 1 / 6)
    w = risk.mean_risk(returns, "cvar", upper=0.3, turnover=0.1, costs=0.001, previous=old)
    assert w.max() <= 0.3 + 1e-7 and np.abs(w - old).max() <= 0.1 + 1e-7
    assert np.allclose(risk.mean_risk(returns, "variance", "utility", previous=old, costs=10.0), old, atol=1e-5)
    floor = np.sort(returns.mean(axis=0))[-2]
    assert returns.mean(axis=0) @ risk.mean_risk(returns, "mean_absolute_deviation", floor=floor) >= floor - 1e-8
    a, b, _, _ = equations.rows(["risky <= 0.2"], list("abcdef"), {"e": ["risky"], "f": ["risky"]})
    assert risk.mean_risk(-returns, "variance", "utility", rows=(a, b))[4:].sum() <= 0.2 + 1e-7
    ratio = lambda w: returns.mean(axis=0) @ w / value(w, returns, "cvar")
    best = ratio(risk.mean_risk(returns, "cvar", "ratio"))
    assert all(ratio(o) <= best + 1e-6 for o in np.random.default_rng(2).dirichlet(np.ones(6), 200))
    with pytest.raises(allocation.OptimizationError):
        risk.mean_risk(-np.abs(returns), "cvar", "ratio")


def test_allocators_by_key_with_fallback(spark, returns):
    rows = [(k, t, f"a{i}", float(returns[t, i]) if (k, i, t) != (1, 2, 5) else None, "least_cvar") for k in (0, 1) for t in range(20) for i in range(6)]
    risk.ALLOCATORS["failing"] = lambda x: risk.mean_risk(-np.abs(x), "cvar", "ratio")
    rows += [(2, t, f"a{i}", float(returns[t, i]), "failing") for t in range(20) for i in range(6)]
    got = risk.allocate(spark.createDataFrame(rows, "k int, t int, asset string, r double, allocator string"), ["k"]).toPandas()
    del risk.ALLOCATORS["failing"]
    assert got.groupby("k")["weight"].sum().round(6).tolist() == [1, 1, 1]
    assert len(got[got["k"] == 1]) == 5 and got.loc[got["k"] == 2, "failed"].all() and not got.loc[got["k"] < 2, "failed"].any()


def test_inversions_and_tau():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 33):
        y = rng.integers(0, 6, n).astype(float)
        assert matrices.inversions(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))
    x, y = rng.integers(0, 5, 40).astype(float), rng.integers(0, 5, 40).astype(float)
    x[3] = np.nan
    on = ~np.isnan(x)
    s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in np.flatnonzero(on) for j in np.flatnonzero(on) if i < j]
    a, b = np.array(s).T
    assert matrices.kendall_tau(x, y) == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def test_tiles_give_what_one_block_gives(spark, monkeypatch, returns):
    rows = [(int(t), f"a{i}", float(returns[t, i])) for t in range(20) for i in range(6) if (t + i) % 7]
    series = spark.createDataFrame(rows, "t int, asset string, r double").withColumn("t", F.expr("date_add(date'2020-01-01', t)"))
    one = {(r["asset_i"], r["asset_j"]): r["v"] for r in matrices.ew_covariance(series, 5.0).collect()}
    monkeypatch.setattr(matrices, "WIDE", 2)
    many = {(r["asset_i"], r["asset_j"]): r["v"] for r in matrices.ew_covariance(series, 5.0).collect()}
    assert len(one) == 36 and many == pytest.approx(one)


def test_leaf_order_is_the_best_that_the_tree_allows():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(7, 3))
    d = np.linalg.norm(p[:, None] - p[None, :], axis=2)
    merges = allocation.linkage(d)
    sets = {i: {i} for i in range(7)}
    for k, (a, b, _, size) in enumerate(merges):
        sets[7 + k] = sets[a] | sets[b]
        assert len(sets[7 + k]) == size
    allowed = [o for o in itertools.permutations(range(7)) if all(max(at) - min(at) == len(s) - 1 for s in sets.values() for at in [[o.index(x) for x in s]])]
    length = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))
    found = allocation.leaf_order(merges, d)
    assert tuple(found) in set(allowed) and length(found) == pytest.approx(min(map(length, allowed)))
    # Ward heights of the first merge and of the whole: the closest pair, and the growth of the sum of squares.
    assert merges[0][2] == pytest.approx(d[np.triu_indices(7, 1)].min()) and [m[2] for m in merges] == sorted(m[2] for m in merges)


def test_fronts_equal_peeling(spark):
    rng = np.random.default_rng(6)
    rows = [(str(i), float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 8, (60, 2)))]
    got = {r["portfolio_id"]: r["front"] for r in portfolios.fronts(spark.createDataFrame(rows, "portfolio_id string, x double, y double"), ["x"], ["y"]).collect()}
    left, want, k = rows, {}, 0
    while left:
        top = [p for p in left if not any(q[1] >= p[1] and q[2] <= p[2] and q[1:] != p[1:] for q in left)]
        want |= {p[0]: k for p in top}
        left, k = [p for p in left if p not in top], k + 1
    assert got == want


def test_equations():
    a, b, c, d = equations.rows(['2 * Equity - 0.5*"A 1" <= 0.3 * US + 0.1', "x >= 0.05", "Equity == 0.6"], ["A 1", "x", "y"], {"A 1": ["Equity", "US"], "x": ["Equity", "EU"], "y": ["Bond", "US"]})
    assert a.tolist() == [[pytest.approx(1.2), 2.0, pytest.approx(-0.3)], [0.0, -1.0, 0.0]] and b.tolist() == [0.1, -0.05]
    assert c.tolist() == [[1.0, 1.0, 0.0]] and d.tolist() == [0.6]
    for bad in ("x < 1", "x 1 <= 2", "x <=", "x <= 1 <= 2", "x y <= 1", "2 * <= 1"):
        with pytest.raises(equations.EquationError):
            equations.rows([bad], ["x", "y"])
    with pytest.raises(equations.GroupNotFoundError):
        equations.rows(["z <= 1"], ["x"])


def test_entropy_pooling(spark):
    rows = spark.createDataFrame([(0.25, float(x)) for x in (1, 2, 3, 4)], "p double, x double")
    got = priors.entropy_pooling(rows, [("x", 3.0)]).toPandas()
    assert got["q"].sum() == pytest.approx(1) and (got["q"] * got["x"]).sum() == pytest.approx(3)
    ratios = got.sort_values("x")["q"].to_numpy()
    assert np.allclose(ratios[1:] / ratios[:-1], ratios[1] / ratios[0])  # an exponential tilt
    with pytest.raises(allocation.OptimizationError):
        priors.entropy_pooling(rows, [("x", 5.0)])


def test_mahalanobis_calibration(spark, returns):
    cov = np.cov(returns.T)
    names = [f"a{i}" for i in range(6)]
    forecast = spark.createDataFrame([(1, a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "k int, asset_i string, asset_j string, v double")
    realised = spark.createDataFrame([(1, t, a, float(returns[t, i])) for t in range(5) for i, a in enumerate(names)], "k int, t int, asset string, r double")
    total = returns[:5].sum(axis=0)
    got = forecasts.mahalanobis_calibration(forecast, realised, ["k"]).first()
    assert got["mahalanobis_ratio"] == pytest.approx(total @ np.linalg.solve(5 * cov, total) / 6)
