"""Student's t, Johnson's S_U, t copulas, stacking, online search, draws: against closed forms and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import copulas as cp
from panelspark.functions import special
from panelspark.operators import portfolios as pf
from panelspark.plans import clusters as cl
from panelspark.plans import distributions as di
from panelspark.streaming import exponential as ew


def test_student_closed_forms():
    x = np.array([-30.0, -2.5, -0.3, 0.0, 0.7, 4.0, 100.0])
    assert np.allclose(special.student_cdf(x, 1), 0.5 + np.arctan(x) / math.pi, rtol=1e-10)
    assert np.allclose(special.student_cdf(x, 2), 0.5 + x / (2 * np.sqrt(2 + x * x)), rtol=1e-10)
    assert np.allclose(special.student_cdf(x[1:-1], 1e7), special.normal_cdf(x[1:-1]), atol=1e-6)
    for k in (1.5, 4.0, 30.0):
        p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999])
        assert np.allclose(special.student_cdf(special.student_ppf(p, k), k), p, rtol=1e-9)
    assert special.student_ppf(np.array([0.0, 1.0]), 3).tolist() == [-math.inf, math.inf]


def test_student_copula(spark):
    u, v, e = np.array([0.3, 0.7]), np.array([0.4, 0.1]), 1e-5
    score = lambda p: special.student_ppf(p, 4.0)
    rows = [(float(a + s), float(b)) for a, b in zip(u, v, strict=True) for s in (-e, e)]
    h = [r["h"] for r in spark.createDataFrame(rows, "u double, v double").coalesce(1).select(cp.student_h(F.col("u"), F.col("v"), 0.5, 4.0).alias("h")).collect()]
    slope = (np.array(h[1::2]) - np.array(h[::2])) / (2 * e)
    assert np.allclose(slope, np.exp(cp.student_log_density(score(u), score(v), 0.5, 4.0)), rtol=1e-4)


def test_the_degrees_of_freedom_are_found(spark):
    rng = np.random.default_rng(8)
    z = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 4000) / np.sqrt(rng.chisquare(3, 4000) / 3)[:, None]
    w = special.student_cdf(z, 3.0)
    pairs = spark.createDataFrame([("a", "b", float(x), float(y)) for x, y in w], "asset_i string, asset_j string, u double, v double")
    (got,) = cp.fit_student(pairs, spark.createDataFrame([("a", "b", 2 / math.pi * math.asin(0.5))], "asset_i string, asset_j string, tau double")).collect()
    assert got["rho"] == pytest.approx(0.5) and 2.4 < got["freedom"] < 3.8


def test_families_of_returns(spark):
    rng = np.random.default_rng(1)
    x = {"n": rng.normal(0.01, 0.2, 3000), "t": 0.1 + 0.02 * rng.standard_t(3, 3000), "j": 0.5 + 0.1 * np.sinh((rng.normal(size=3000) - 1.0) / 1.2), "flat": np.ones(5)}
    series = spark.createDataFrame([(a, float(v)) for a, s in x.items() for v in s] + [("n", None)], "asset string, r double")
    got = {(r["asset"], r["family"]): r for r in di.fit(series).collect()}
    assert len(got) == 9 and not any(a == "flat" for a, _ in got)
    assert [got[("t", "student_t")][c] for c in ("loc", "scale", "shape_a")] == pytest.approx([0.1, 0.02, 3.0], rel=0.15)
    assert [got[("j", "johnson_su")][c] for c in ("loc", "scale", "shape_a", "shape_b")] == pytest.approx([0.5, 0.1, 1.0, 1.2], rel=0.2)
    best = {a: f for (a, f), r in got.items() if r["best"]}
    assert best["t"] == "student_t" and best["j"] == "johnson_su"
    assert got[("n", "normal")]["log_likelihood"] == pytest.approx(-1500 * (math.log(2 * math.pi * x["n"].var()) + 1))


def test_stacked_weights():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 4)) * [1, 2, 3, 4]
    first, last = (lambda v: np.eye(4)[0]), (lambda v: np.eye(4)[3])
    share = lambda v: (1 / v.var(axis=0)) / (1 / v.var(axis=0)).sum()
    assert np.allclose(cl.stacked(x, [first, last], share), share(x[:, [0, 3]])[0] * np.eye(4)[0] + share(x[:, [0, 3]])[1] * np.eye(4)[3])
    assert np.allclose(cl.stacked(x, [first], share, None), [1, 0, 0, 0])


def test_half_life_search_against_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 60) * np.repeat([0.1, 0.4, 0.1], 20)
    series = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)] + [(99, "a", None), (0, "short", 0.1)], "t int, asset string, r double")
    got = {r["half_life"]: r for r in ew.search_half_life(series, [2, 30], 10).collect()}
    for h in (2.0, 30.0):
        lam, loss = 2 ** (-1 / h), []
        for i in range(10, 60):
            w = (1 - lam) * lam ** np.arange(i)[::-1]
            v = (w * x[:i] ** 2).sum() / (1 - lam**i)
            loss.append(math.log(v) + x[i] ** 2 / v)
        assert got[h]["score"] == pytest.approx(np.mean(loss)) and got[h]["n"] == 50
    assert got[2.0]["best"] != got[30.0]["best"]


def test_comparisons(spark):
    people = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0)], "portfolio_id string, mean double, risk double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")], "a string, b string")
    assert {(r["a"], r["b"]): r["dominates"] for r in pf.compare(people, pairs, ["mean"], ["risk"]).collect()} == {("a", "b"): True, ("b", "a"): False, ("a", "a"): False, ("a", "c"): False}
