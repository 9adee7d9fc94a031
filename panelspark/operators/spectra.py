"""Covariances cleaned in their spectrum: eigenvalues of noise levelled, components of the market removed. N x N numbers on the driver."""

from __future__ import annotations

import numpy as np


def rescaled(corr: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """A covariance with these deviations and the correlations that ``corr`` has after its diagonal is set to 1."""
    own = np.sqrt(np.diag(corr))
    return corr / np.outer(own, own) * np.outer(sd, sd)


def split(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviations, eigenvalues of the correlation from the largest, eigenvectors)."""
    sd = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    return sd, values[::-1], vectors[:, ::-1]


def _density(points: np.ndarray, at: np.ndarray, width: float = 0.01) -> np.ndarray:
    """A Gaussian kernel estimate from ``points``."""
    z = (at[:, None] - points[None, :]) / width
    return np.exp(-z * z / 2).mean(axis=1) / (width * np.sqrt(2 * np.pi))


def noise_edge(values: np.ndarray, ratio: float) -> float:
    """The highest eigenvalue that noise explains, for ``ratio`` observations an asset.

    The variance of the noise is where the Marchenko-Pastur density is nearest, in squares over a grid of 1,000 eigenvalues, to
    the kernel estimate taken at the density's own values. It is sought downhill from one half, within 0 and 1.
    """
    root = np.sqrt(1 / ratio)

    def miss(variance: float) -> float:
        low, high = variance * (1 - root) ** 2, variance * (1 + root) ** 2
        x = np.linspace(low, high, 1000)
        pdf = ratio / (2 * np.pi * variance * x) * np.sqrt(np.maximum((high - x) * (x - low), 0))
        return float(((_density(values, pdf) - pdf) ** 2).sum())

    at, step, here = 0.5, 0.05, miss(0.5)
    while step > 1e-7:
        tried = [(miss(v), v) for v in (at - step, at + step) if 1e-5 <= v <= 1 - 1e-5]
        best = min(tried, default=(np.inf, at))
        if best[0] < here:
            here, at = best
        else:
            step /= 2
    return at * (1 + root) ** 2


def denoised(cov: np.ndarray, observations: int) -> np.ndarray:
    """Eigenvalues below the noise's edge become their mean; variances stay."""
    sd, values, vectors = split(cov)
    noise = values < noise_edge(values, observations / len(cov))
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    return rescaled((vectors * values) @ vectors.T, sd)


def detoned(cov: np.ndarray, markets: int = 1) -> np.ndarray:
    """Without the ``markets`` largest components of the correlation; variances stay."""
    sd, values, vectors = split(cov)
    kept = np.where(np.arange(len(values)) < markets, 0.0, values)
    return rescaled((vectors * kept) @ vectors.T, sd)
