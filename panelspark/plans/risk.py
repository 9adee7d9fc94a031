"""Portfolios of least risk, highest utility or highest ratio under convex risk measures, as quadratic programs.

A problem is a key with its scenarios. Problems (splits, measures, universes) are solved side by side, each in one task that
holds the scenarios of its own problem; nothing comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allocation import OptimizationError, hierarchical_risk_parity, maximum_diversification, risk_budgeting, schur_complementary
from .clusters import equal_risk_contribution, nested, stacked

RISKS = ("variance", "semi_variance", "mean_absolute_deviation", "first_lower_partial_moment", "cvar", "worst_realization", "max_drawdown", "average_drawdown", "cdar", "ulcer_index")


def solve_qp(p: np.ndarray, q: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 80, tolerance: float = 1e-9) -> np.ndarray:
    """The x that minimises x'Px / 2 + q'x with Gx <= h and Ax = b: primal-dual interior points with a corrector."""
    n, m, k = len(q), len(h), len(b)

    def newton(d: np.ndarray, top: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kkt = np.zeros((n + k, n + k))
        kkt[:n, :n] = p + (g.T * d) @ g + 1e-11 * np.eye(n)
        kkt[:n, n:], kkt[n:, :n] = a.T, a
        kkt[n:, n:] = -1e-13 * np.eye(k)
        both = np.linalg.solve(kkt, np.r_[top, low])
        return both[:n], both[n:]

    x, y = newton(np.ones(m), -q + g.T @ h, b)
    r = h - g @ x
    s, z = np.maximum(r, 1.0), np.maximum(-r, 1.0)
    scale = 1 + max(np.abs(q).max(initial=0), np.abs(h).max(initial=0), np.abs(b).max(initial=0))
    for _ in range(rounds):
        rx, ry, rz, mu = p @ x + q + a.T @ y + g.T @ z, a @ x - b, g @ x + s - h, float(s @ z) / max(m, 1)
        if max(np.abs(rx).max(initial=0), np.abs(ry).max(initial=0), np.abs(rz).max(initial=0)) < tolerance * scale and mu < tolerance * scale:
            return x
        d, centre = z / s, s * z
        for corrected in (False, True):
            dx, dy = newton(d, -rx - g.T @ ((z * rz - centre) / s), -ry)
            ds = -rz - g @ dx
            dz = (-centre - z * ds) / s
            least = [float((-v[dv < 0] / dv[dv < 0]).min(initial=np.inf)) for v, dv in ((s, ds), (z, dz))]
            step = min(1.0, 0.995 * min(least))
            if not corrected:
                left = float((s + step * ds) @ (z + step * dz)) / max(m, 1)
                centre = s * z + ds * dz - mu * (left / mu) ** 3
        x, y, z, s = x + step * dx, y + step * dy, z + step * dz, s + step * ds
    raise OptimizationError("no solution within the tolerance")


class Program:
    """Rows of a program over named blocks of variables."""

    def __init__(self) -> None:
        self.n, self.less, self.equal, self.cost, self.squares = 0, [], [], [], []

    def block(self, size: int) -> slice:
        self.n += size
        return slice(self.n - size, self.n)

    def _row(self, parts: list[tuple[slice, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(np.atleast_2d(parts[0][1])), self.n))
        for at, m in parts:
            out[:, at] += np.atleast_2d(m)
        return out

    def solve(self) -> np.ndarray:
        q, p = np.zeros(self.n), np.zeros((self.n, self.n))
        for at, c in self.cost:
            q[at] += c
        for parts, weight in self.squares:
            m = self._row(parts)
            p += 2 * weight * m.T @ m
        size = max(np.abs(p).max(initial=0), np.abs(q).max(initial=0)) or 1.0
        p, q = p / size, q / size  # so that the tolerance means the same for any unit of risk
        stack = lambda rows: (np.concatenate([self._row(r) for r, _ in rows]), np.concatenate([np.atleast_1d(v) for _, v in rows])) if rows else (np.zeros((0, self.n)), np.zeros(0))
        return solve_qp(p, q, *stack(self.less), *stack(self.equal))


def _risk(program: Program, w: slice, x: np.ndarray, risk: str, beta: float, weight: float) -> None:
    """Adds ``weight`` times the risk of returns x times weights w to the program's cost."""
    t, eye = len(x), np.eye(len(x))
    centred = x - x.mean(axis=0)
    if risk == "variance":
        program.squares.append(([(w, centred)], weight / (t - 1)))
        return
    if risk in ("semi_variance", "mean_absolute_deviation", "first_lower_partial_moment"):
        d = program.block(t)
        program.less += [([(w, -centred), (d, -eye)], np.zeros(t)), ([(w, centred), (d, -eye)] if risk == "mean_absolute_deviation" else [(d, -eye)], np.zeros(t))]
        if risk == "semi_variance":
            program.squares.append(([(d, eye)], weight / (t - 1)))
        else:
            program.cost.append((d, weight / t))
        return
    # What may be lost at each date: the return itself, or the fall from the highest sum so far.
    loss: list[tuple[slice, np.ndarray]] = [(w, -x)]
    if risk in ("max_drawdown", "average_drawdown", "cdar", "ulcer_index"):
        total, top = np.cumsum(x, axis=0), program.block(t)
        loss = [(top, eye), (w, -total)]
        program.less += [([(w, total), (top, -eye)], np.zeros(t)), ([(top, eye[:-1] - eye[1:])], np.zeros(t - 1))]
        if risk == "average_drawdown":
            program.cost += [(top, weight / t), (w, -weight * total.mean(axis=0))]
            return
        if risk == "ulcer_index":
            program.squares.append((loss, weight / t))
            return
    level = program.block(1)
    program.cost.append((level, weight))
    ones = np.ones((t, 1))
    if risk in ("cvar", "cdar"):
        over = program.block(t)
        program.cost.append((over, weight / ((1 - beta) * t)))
        program.less += [([*loss, (level, -ones), (over, -eye)], np.zeros(t)), ([(over, -eye)], np.zeros(t))]
    else:  # the worst return, the deepest fall
        program.less.append(([*loss, (level, -ones)], np.zeros(t)))


def mean_risk(
    x: np.ndarray, risk: str = "variance", objective: str = "risk", beta: float = 0.95, lower=0.0, upper=1.0, budget: float = 1.0, aversion: float = 1.0,
    floor: float | None = None, previous: np.ndarray | None = None, costs=0.0, turnover: float | None = None, rows: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Weights of returns x (dates, assets).

    ``objective``: least ``risk``, highest ``utility`` (mean less aversion times risk) or highest ``ratio`` of mean to risk.
    Weights lie within ``lower`` and ``upper`` and add up to ``budget``; ``floor`` is a least mean, ``rows`` = (A, b) asks
    A w <= b, ``costs`` per unit traded from ``previous`` lower the mean, and ``turnover`` bounds each asset's trade.
    """
    if risk not in RISKS:
        raise ValueError(f"unknown risk {risk}")
    n, mean = x.shape[1], x.mean(axis=0)
    program = Program()
    w, eye = program.block(n), np.eye(n)
    lower, upper, costs = (np.broadcast_to(np.asarray(v, dtype=float), n) for v in (lower, upper, costs))
    ratio = objective == "ratio"
    # For ratios all is scaled so that the mean is 1; the last block is the scale, 1 elsewhere.
    k = program.block(1)
    column = lambda v: np.asarray(v, dtype=float).reshape(-1, 1)
    program.less += [([(w, eye), (k, -column(upper))], np.zeros(n)), ([(w, -eye), (k, column(lower))], np.zeros(n)), ([(k, -np.ones((1, 1)))], np.zeros(1))]
    program.equal.append(([(w, np.ones((1, n))), (k, -column([budget]))], np.zeros(1)))
    gain: list[tuple[slice, np.ndarray]] = [(w, mean[None, :])]
    if previous is not None and (costs.any() or turnover is not None):
        trade = program.block(n)
        program.less += [([(w, eye), (trade, -eye), (k, -column(previous))], np.zeros(n)), ([(w, -eye), (trade, -eye), (k, column(previous))], np.zeros(n))]
        gain.append((trade, -costs[None, :]))
        if turnover is not None:
            program.less.append(([(trade, eye), (k, -column(np.full(n, turnover)))], np.zeros(n)))
    if rows is not None:
        program.less.append(([(w, rows[0]), (k, -column(rows[1]))], np.zeros(len(rows[1]))))
    if floor is not None:
        program.less.append(([(at, -m) for at, m in gain] + [(k, np.array([[floor]]))], np.zeros(1)))
    if ratio:
        if not (mean > 0).any():
            raise OptimizationError("no asset has a positive mean")
        program.equal.append((gain, np.ones(1)))
    else:
        program.equal.append(([(k, np.ones((1, 1)))], np.ones(1)))
    if objective == "utility":
        program.cost += [(at, -m[0]) for at, m in gain]
    _risk(program, w, x, risk, beta, aversion if objective == "utility" else 1.0)
    found = program.solve()
    return found[w] / found[k]


def track(x: np.ndarray, benchmark: np.ndarray, risk: str = "variance", **options) -> np.ndarray:
    """Weights of sum 1 whose returns differ from the benchmark's with the least ``risk``: least risk of the returns less the benchmark's."""
    return mean_risk(x - np.asarray(benchmark, dtype=float)[:, None], risk, budget=1.0, **options)


#: Allocators by name: weights from scenarios (dates, assets).
ALLOCATORS = {
    "equal": lambda x: np.full(x.shape[1], 1 / x.shape[1]),
    "inverse_volatility": lambda x: (1 / x.std(axis=0, ddof=1)) / (1 / x.std(axis=0, ddof=1)).sum(),
    "risk_parity": lambda x: risk_budgeting(np.atleast_2d(np.cov(x.T))),
    "hierarchical_risk_parity": lambda x: hierarchical_risk_parity(np.atleast_2d(np.cov(x.T))),
    "maximum_diversification": lambda x: maximum_diversification(np.atleast_2d(np.cov(x.T))),
    "schur_complementary": lambda x: schur_complementary(np.atleast_2d(np.cov(x.T)))[0],
    "random": lambda x: np.random.default_rng(len(x)).dirichlet(np.ones(x.shape[1])),
    "hierarchical_equal_risk": equal_risk_contribution,
    "nested_clusters": lambda x: nested(x, lambda v: mean_risk(v, "variance"), lambda v: risk_budgeting(np.atleast_2d(np.cov(v.T)))),
    "stacked": lambda x: stacked(x, [ALLOCATORS["inverse_volatility"], ALLOCATORS["risk_parity"], ALLOCATORS["hierarchical_risk_parity"]], lambda v: mean_risk(v, "cvar")),
} | {f"least_{r}": (lambda x, r=r: mean_risk(x, r)) for r in RISKS}


def allocate(series: DataFrame, keys: list[str], allocator: str = "allocator", fallback: str | tuple[str, ...] | None = "equal") -> DataFrame:
    """(keys, allocator, asset, weight, failed): one problem for every value of ``keys`` and ``allocator``, a column of ``series`` (keys, t, asset, r).

    Only assets with a return on every date of the problem take part. Where an allocator fails, the first of ``fallback`` that does not
    answers, and ``failed`` says so; where none does the weights are NULL.
    """
    chain = (fallback,) if isinstance(fallback, str) else fallback or ()
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "") + "allocator string, asset string, weight double, failed boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="asset", values="r").dropna(axis=1)
        name, weights, failed = pdf[allocator].iloc[0], np.full(wide.shape[1], np.nan), False
        for tried in (name, *chain):
            try:
                weights = ALLOCATORS[tried](wide.to_numpy(float))
                break
            except (OptimizationError, np.linalg.LinAlgError):
                failed = True
        out = pd.DataFrame({"allocator": name, "asset": wide.columns, "weight": weights, "failed": failed})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    found = series.select(*keys, F.col(allocator).alias(allocator), "t", "asset", "r").groupBy(*keys, allocator).applyInPandas(run, schema)
    return found.withColumn("weight", F.nanvl("weight", F.lit(None).cast("double")))


def out_of_sample(series: DataFrame, trained: DataFrame, tested: DataFrame, allocators: list[str]) -> DataFrame:
    """(split_id, allocator, t, r): returns on the test dates of every split of the portfolios that its training dates give.

    ``trained`` and ``tested`` hold (split_id, t). All splits and allocators are solved side by side.
    """
    each = F.explode(F.array(*map(F.lit, allocators))).alias("allocator")
    weights = allocate(series.join(trained, "t").select("split_id", "t", "asset", "r", each), ["split_id"])
    met = series.join(tested, "t").join(weights.where("weight is not null"), ["split_id", "asset"])
    return met.groupBy("split_id", "allocator", "t").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
