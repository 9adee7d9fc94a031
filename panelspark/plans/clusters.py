"""Allocation over clusters of a Ward tree: equal risk contributions down the tree, and optimizers nested in clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .allocation import OptimizationError, linkage

Allocator = Callable[[np.ndarray], np.ndarray]


def cut(merges: list[tuple[int, int, float, int]], count: int) -> list[list[int]]:
    """The leaves of the ``count`` clusters that are left when the last ``count`` - 1 merges are undone, by smallest leaf."""
    n = len(merges) + 1
    parts = {i: [i] for i in range(n)}
    for k, (a, b, _, _) in enumerate(merges[: n - count]):
        parts[n + k] = parts.pop(a) + parts.pop(b)
    return sorted(sorted(p) for p in parts.values())


def best_count(distance: np.ndarray, merges: list[tuple[int, int, float, int]]) -> int:
    """The number of clusters where the curve of dispersions over the number bends most upwards.

    The dispersion of a clustering is the sum over its clusters of the mean distance of two members. Numbers up to 8, or the root of the number of
    assets if that is more, are compared; with fewer than three there is no bend, and every asset is a cluster.
    """
    n = len(distance)
    most = min(n, max(8, round(np.sqrt(n))))
    if most < 3:
        return n
    spread = lambda p: distance[np.ix_(p, p)].sum() / (len(p) * (len(p) - 1)) if len(p) > 1 else 0.0
    w = np.array([sum(map(spread, cut(merges, k))) for k in range(1, most + 1)])
    return int(np.argmax(np.diff(w, 2))) + 2


def correlation_distance(x: np.ndarray) -> np.ndarray:
    """sqrt((1 - correlation) / 2) of the columns."""
    d = np.sqrt(np.clip((1 - np.atleast_2d(np.corrcoef(x.T))) / 2, 0, 1))
    np.fill_diagonal(d, 0)
    return d


def within(weights: np.ndarray, lower=0.0, upper=1.0) -> np.ndarray:
    """The weights of sum 1 between the bounds with the least sum of squared relative changes: w + s * w ** 2, clipped, for the s that gives the sum."""
    lower, upper = (np.broadcast_to(np.asarray(v, dtype=float), weights.shape) for v in (lower, upper))
    if ((weights >= lower) & (weights <= upper)).all():
        return weights
    if lower.sum() > 1 or upper.sum() < 1 or (lower > upper).any():
        raise OptimizationError("no weights of sum 1 lie between the bounds")
    at = lambda s: np.clip(weights + s * weights**2, lower, upper)
    reach = 2.0 / weights.min() ** 2
    low, high = -reach, reach
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() < 1 else (low, middle)
    return at((low + high) / 2)


def equal_risk_contribution(x: np.ndarray, risk: Callable[[np.ndarray], float] | None = None, lower=0.0, upper=1.0, count: int | None = None) -> np.ndarray:
    """Weights against risk within clusters; between them, each fork of the tree splits weight against the summed risks of the clusters on its sides.

    ``risk`` maps returns to a positive number (the sample variance by default).
    """
    risk = risk or (lambda r: float(r.var(ddof=1)))
    n = x.shape[1]
    if n == 1:
        return np.ones(1)
    merges = linkage(correlation_distance(x))
    count = best_count(correlation_distance(x), merges) if count is None else count
    single = np.array([risk(x[:, i]) for i in range(n)])
    weights, total = np.zeros(n), {}
    clusters = cut(merges, count)
    owner = {leaf: c for c, part in enumerate(clusters) for leaf in part}
    for c, part in enumerate(clusters):
        v = 1 / single[part]
        weights[part] = v / v.sum()
        total[c] = risk(x[:, part] @ weights[part])
    # A node below the cut stands for its cluster; one above it, for the clusters of both its sides.
    under = {i: [owner[i]] for i in range(n)}
    for k, (a, b, _, _) in enumerate(merges):
        under[n + k] = sorted({*under[a], *under[b]})
    share = np.ones(len(clusters))
    for a, b, _, _ in merges[n - count :]:
        left, right = (sum(total[c] for c in under[s]) for s in (a, b))
        share[under[a]] *= right / (left + right)
        share[under[b]] *= left / (left + right)
    return within(weights * share[[owner[i] for i in range(n)]], lower, upper)


def nested(x: np.ndarray, inner: Allocator, outer: Allocator, folds: int | None = 5, count: int | None = None) -> np.ndarray:
    """``inner`` weights the assets of each cluster, ``outer`` the clusters by their returns under the inner weights.

    Those returns are out of sample: each of ``folds`` runs of dates is met with inner weights of the other dates. Without
    ``folds`` they are those of the whole sample's weights.
    """
    t, n = x.shape
    if n == 1:
        return np.ones(1)
    distance = correlation_distance(x)
    merges = linkage(distance)
    clusters = cut(merges, best_count(distance, merges) if count is None else count)
    solve = lambda rows, part: inner(x[np.ix_(rows, part)]) if len(part) > 1 else np.ones(1)
    every = np.arange(t)
    held = [solve(every, p) for p in clusters]
    met = np.column_stack([x[:, p] @ w for p, w in zip(clusters, held, strict=True)])
    if folds:
        for test in np.array_split(every, folds):
            train = np.setdiff1d(every, test)
            for c, p in enumerate(clusters):
                met[test, c] = x[np.ix_(test, p)] @ solve(train, p)
    top = outer(met) if len(clusters) > 1 else np.ones(1)
    out = np.zeros(n)
    for p, w, share in zip(clusters, held, top, strict=True):
        out[p] = w * share
    return out


def stacked(x: np.ndarray, inner: list[Allocator], outer: Allocator, folds: int | None = 5) -> np.ndarray:
    """``outer`` weights the portfolios of several allocators by their returns out of sample, as ``nested`` makes them; the sum of the portfolios so weighted."""
    every = np.arange(len(x))
    held = np.array([solve(x) for solve in inner])
    met = x @ held.T
    if folds:
        for test in np.array_split(every, folds):
            train = x[np.setdiff1d(every, test)]
            met[test] = x[test] @ np.array([solve(train) for solve in inner]).T
    return (outer(met) if len(inner) > 1 else np.ones(1)) @ held
