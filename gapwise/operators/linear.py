"""Small linear algebra on moment matrices M = sum z z', z = [1, x]; index 0 is the constant."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LinearFit:
    """Prediction of column ``target`` (1-based in z) as coef . z, with the pieces noise needs."""
    target: int
    coef: np.ndarray
    residual_sd: float = 0.0
    noise_var: float = 0.0
    coef_cov: np.ndarray | None = None
    centre: np.ndarray | None = None


def _centred(m: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float]:
    others = np.array([i for i in range(1, len(m)) if i != target], dtype=int)
    n = m[0, 0]
    xm, ym = m[0, others] / n, m[0, target] / n
    xx = m[np.ix_(others, others)] - n * np.outer(xm, xm)
    xy = m[others, target] - n * xm * ym
    yy = max(m[target, target] - n * ym * ym, 0.0)
    return others, xx, yy, xy, ym, n


def _spread(m: np.ndarray, target: int, others: np.ndarray, slope: np.ndarray, intercept: float) -> np.ndarray:
    coef = np.zeros(len(m))
    coef[others] = slope
    coef[0] = intercept
    return coef


def least_squares(m: np.ndarray, target: int) -> LinearFit:
    """Ordinary least squares with intercept; minimum-norm on collinear predictors."""
    others, xx, yy, xy, ym, n = _centred(m, target)
    size = np.sqrt(np.maximum(np.diag(xx), 0.0))
    size[size == 0] = 1.0
    slope = np.linalg.pinv(xx / np.outer(size, size), rcond=1e-13, hermitian=True) @ (xy / size) / size
    coef = _spread(m, target, others, slope, ym - slope @ (m[0, others] / n))
    sse = max(yy - 2 * slope @ xy + slope @ xx @ slope, 0.0)
    return LinearFit(target, coef, residual_sd=float(np.sqrt(sse / n)))


# Fixed values of the method: hyperprior 1e-6 on both precisions, tolerance 1e-3, at most 300 rounds.
HYPER, RIDGE_TOL, RIDGE_ROUNDS = 1e-6, 1e-3, 300


def bayesian_ridge(m: np.ndarray, target: int) -> LinearFit:
    """Evidence maximisation (MacKay 1992, Tipping 2001) from moments only.

    Noise precision ``alpha`` and weight precision ``lam`` are re-estimated in turn; the posterior
    covariance of the slopes is kept for drawing from the predictive distribution.
    """
    others, xx, yy, xy, ym, n = _centred(m, target)
    eig, vec = np.linalg.eigh(xx)
    eig = np.maximum(eig, 0.0)
    proj = vec.T @ xy
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0

    def posterior_mean() -> tuple[np.ndarray, float]:
        slope = vec @ (proj / (eig + lam / alpha))
        return slope, max(yy - 2 * slope @ xy + slope @ xx @ slope, 0.0)

    last = None
    for _ in range(RIDGE_ROUNDS):
        slope, sse = posterior_mean()
        used = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (used + 2 * HYPER) / (slope @ slope + 2 * HYPER)
        alpha = (n - used + 2 * HYPER) / (sse + 2 * HYPER)
        if last is not None and np.abs(last - slope).sum() < RIDGE_TOL:
            break
        last = slope
    slope, _ = posterior_mean()
    centre = m[0, others] / n
    cov = (vec / (alpha * eig + lam)) @ vec.T
    coef = _spread(m, target, others, slope, ym - slope @ centre)
    wide_cov, wide_centre = np.zeros_like(m), np.zeros(len(m))
    wide_cov[np.ix_(others, others)] = cov
    wide_centre[others] = centre
    return LinearFit(target, coef, noise_var=float(1.0 / alpha), coef_cov=wide_cov, centre=wide_centre)
