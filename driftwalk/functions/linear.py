"""Linear forecasts from moments, for batches of moment rows.

``spreads`` holds the sums of products about the means of the variables' pairs
``i <= j`` with the target last; coefficients are the weights followed by the
intercept.
"""

from __future__ import annotations

import numpy as np

# Machine precision. A spread within a few roundings of the level it was taken
# about is no spread, and a direction within a few of the largest no direction.
EPS = np.finfo(float).eps
ROUNDINGS = 64


def centred(n: np.ndarray, sums: np.ndarray, spreads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances per row."""
    rows, width = sums.shape
    count = np.where(n > 0, n, np.nan)[:, None]
    upper = np.triu_indices(width)
    cov = np.zeros((rows, width, width))
    cov[:, upper[0], upper[1]] = spreads / count
    cov[:, upper[1], upper[0]] = spreads / count
    return sums / count, cov


def ridge(means: np.ndarray, cov: np.ndarray, penalty: float) -> np.ndarray:
    """Least squares with a penalty on the weights; NaN rows stay NaN.

    Features are brought to unit spread first, so that their units decide nothing;
    the penalty is on the weights in the given units. Of features that determine each
    other the smallest weights are taken; a constant feature has none.
    """
    inner, width = cov[:, :-1, :-1], cov.shape[1] - 1
    known = np.isfinite(inner).all(axis=(1, 2))
    weights = np.full(means[:, :-1].shape, np.nan)
    spread = np.sqrt(np.maximum(np.einsum("nii->ni", inner[known]), 0.0))
    varies = spread > ROUNDINGS * EPS * np.abs(means[known, :-1])
    scale = np.where(varies, spread, 1.0)
    unit = inner[known] / (scale[:, :, None] * scale[:, None, :])
    unit += penalty * np.eye(width) / (scale * scale)[:, :, None]
    unit *= varies[:, :, None] & varies[:, None, :]
    values, vectors = np.linalg.eigh(unit)
    held = values > ROUNDINGS * width * EPS * values[:, -1:]
    along = np.where(varies, cov[known, :-1, -1] / scale, 0.0)
    turned = np.einsum("nij,ni->nj", vectors, along) / np.where(held, values, 1.0)
    found = np.einsum("nij,nj->ni", vectors, np.where(held, turned, 0.0)) / scale
    for row in np.flatnonzero(~held.all(axis=1)):
        free = np.linalg.qr(vectors[row][:, ~held[row]] / scale[row][:, None])[0]
        found[row] -= free @ (free.T @ found[row])
    weights[known] = found
    return with_intercept(weights, means)


def with_intercept(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The intercept that matches the mean of the target."""
    level = means[:, -1] - (weights * means[:, :-1]).sum(axis=1)
    return np.column_stack([weights, level])


def prediction_moments(
    coefficients: np.ndarray, means: np.ndarray, cov: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and variance of the forecast and its covariance with the target."""
    w = coefficients[:, :-1]
    mean = (w * means[:, :-1]).sum(axis=1) + coefficients[:, -1]
    variance = np.einsum("ni,nij,nj->n", w, cov[:, :-1, :-1], w)
    return mean, np.maximum(variance, 0.0), (w * cov[:, :-1, -1]).sum(axis=1)


def correlation_gradient(weights: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Gradient of ``1 - corr(w x, y)`` by ``w``; zero where it is undefined."""
    inner, c, u = cov[:, :-1, :-1], cov[:, :-1, -1], cov[:, -1, -1]
    moved = np.einsum("nij,nj->ni", inner, weights)
    v = (weights * moved).sum(axis=1)
    known = (v > 0) & (u > 0)
    v, u = np.where(known, v, 1.0), np.where(known, u, 1.0)
    along = (weights * c).sum(axis=1)
    gradient = along[:, None] * moved / (v**1.5 * np.sqrt(u))[:, None] - c / np.sqrt(v * u)[:, None]
    return np.where(known[:, None], gradient, 0.0)
