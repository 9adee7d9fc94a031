"""Allocation by its optimality conditions, splits by counting, states by parity of batch and stream."""

from itertools import combinations

import numpy as np
import pytest

from panelspark.functions.special import normal_cdf, normal_ppf
from panelspark.plans import allocation as al
from panelspark.plans import splits as sp


@pytest.fixture
def market():
    rng = np.random.default_rng(3)
    x = rng.normal(0.01, 0.05, (200, 6)) @ rng.normal(0, 1, (6, 6))
    return x.mean(axis=0), np.cov(x.T)


def test_minimum_variance_satisfies_the_optimality_conditions(market):
    _, cov = market
    w = al.minimise(cov, np.zeros(6))
    g = cov @ w
    assert w.sum() == pytest.approx(1) and w.min() >= 0
    assert np.allclose(g[w > 1e-6], w @ g, rtol=1e-4) and (g >= w @ g - 1e-6).all()


def test_risk_budget(market):
    _, cov = market
    w = al.risk_budgeting(cov)
    share = w * (cov @ w)
    assert np.allclose(share, share.mean(), rtol=1e-6)


def test_frontier_rises_and_unreachable_returns_raise(market):
    mean, cov = market
    points = al.efficient_frontier(cov, mean, 4)
    risks = [w @ cov @ w for w in points]
    assert all(b >= a - 1e-9 for a, b in zip(risks, risks[1:], strict=False))
    with pytest.raises(al.OptimizationError):
        al.minimise(cov, mean, floor=mean.max() + 1)


def test_hierarchical_weights(market):
    w = al.hierarchical_risk_parity(market[1])
    assert w.sum() == pytest.approx(1) and (w > 0).all()


def test_walk_forward():
    out = sp.walk_forward(20, 5, 8, purge=1)
    assert out[:2] == [(0, "train", 0, 8), (0, "test", 9, 14)]
    assert [r[3] for r in sp.walk_forward(20, 5, 8, reduce_test=True) if r[1] == "test"] == [13, 18, 20]
    with pytest.raises(ValueError):
        sp.walk_forward(9, 2, 8, purge=1)


def test_combinatorial_paths_hold_every_fold_once():
    _, paths = sp.combinatorial(60, 6, 2)
    by = {}
    for _, fold, path in paths:
        by.setdefault(path, []).append(fold)
    assert len(by) == sp.n_combinatorial_paths(6, 2)
    assert all(sorted(f) == list(range(6)) for f in by.values())
    assert [sp.combination_by_index(i, 5, 3) for i in range(10)] == list(combinations(range(5), 3))


def test_normal_quantile():
    p = np.array([1e-12, 0.001, 0.3, 0.5, 0.99, 1 - 1e-9])
    assert np.allclose(normal_cdf(normal_ppf(p)), p, rtol=1e-9)


def test_fold_and_stream_agree(spark, tmp_path):
    import pandas as pd

    from panelspark.streaming import exponential as ew

    rng = np.random.default_rng(0)
    rows = pd.DataFrame([(a, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(rng.normal())) for a in "ab" for i in range(12)], columns=["asset", "t", "r"])
    batch = spark.createDataFrame(rows)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = ew.stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), 5)
    query = live.writeStream.format("memory").queryName("ew").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r["asset"]: (r["mean"], r["variance"]) for r in spark.sql("select asset, max_by(mean, t) mean, max_by(variance, t) variance from ew group by asset").collect()}
    for r in ew.fold(batch, 5).collect():
        assert last[r["asset"]] == pytest.approx((r["mean"], r["variance"]))


def test_fronts_are_peeled_until_nothing_is_left(spark):
    from panelspark.operators.portfolios import fronts

    rows = [(f"p{k}{j}", float(-k + j), float(k + j)) for k in range(6) for j in range(2)] + [(None, -9.0, 9.0)]
    population = spark.createDataFrame(rows, "portfolio_id string, mean double, cvar double")
    got = {r["portfolio_id"]: r["front"] for r in fronts(population, ["mean"], ["cvar"]).collect()}
    want, left, k = {}, list(rows), 0
    while left:
        front = [a for a in left if not any(b[1] >= a[1] and b[2] <= a[2] and b[1:] != a[1:] for b in left)]
        want |= {a[0]: k for a in front}
        left, k = [a for a in left if a not in front], k + 1
    assert k > 3 and got == want
    assert fronts(population, ["mean"], ["cvar"], 2).count() == sum(v < 2 for v in want.values())
    assert fronts(population.where("false"), ["mean"], ["cvar"]).count() == 0


def test_james_stein_counts_the_observations_of_the_panel(spark, monkeypatch):
    from panelspark import queries

    rng = np.random.default_rng(9)
    x = rng.normal(0.01, 0.05, (20, 4))
    series = spark.createDataFrame([(f"t{i:02}", f"a{j}", float(x[i, j])) for i in range(20) for j in range(4)], "t string, asset string, r double")
    monkeypatch.setattr(queries, "monthly_returns", lambda s, d: series)
    got = {r["asset"]: r["weight"] for r in queries.QUERIES["mu_shrunk_james_stein"](spark, "").collect()}
    want = al.shrunk_mean(x.mean(axis=0), np.cov(x.T), 20)
    assert [got[f"a{j}"] for j in range(4)] == pytest.approx(want, abs=1e-7)
