"""Expectation-maximisation for a multivariate normal table (Dempster, Laird and Rubin 1977)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from gapwise.functions.missing import Profile
from gapwise.operators.affine import AffineFill
from gapwise.operators.moments import PatternStats, pattern_stats

# Fixed values of the method.
TOLERANCE = 1e-6
START_RIDGE = 1e-8


@dataclass(frozen=True)
class NormalMap:
    """Conditional mean of the missing part given the observed part, in shifted coordinates."""
    mu: np.ndarray
    sigma: np.ndarray

    def slopes(self, mask: np.ndarray) -> np.ndarray:
        m, o = np.flatnonzero(mask), np.flatnonzero(~mask)
        if not len(o):
            return np.zeros((len(m), 0))
        return self.sigma[np.ix_(m, o)] @ np.linalg.pinv(self.sigma[np.ix_(o, o)])

    def rows(self, mask: np.ndarray) -> np.ndarray:
        p = len(mask)
        m, o = np.flatnonzero(mask), np.flatnonzero(~mask)
        out = np.hstack([np.zeros((p, 1)), np.eye(p)])
        beta = self.slopes(mask)
        out[m] = 0.0
        out[m, 0] = self.mu[m] - beta @ self.mu[o]
        out[np.ix_(m, o + 1)] = beta
        return out


@dataclass(frozen=True)
class EMFit:
    fill: AffineFill
    mu: np.ndarray
    sigma: np.ndarray
    iterations: int


def expectation(stats: PatternStats, now: NormalMap) -> tuple[np.ndarray, np.ndarray]:
    """Moments of the completed data and the summed conditional covariance."""
    p = stats.width

    def kernel(masks: np.ndarray, q: np.ndarray) -> np.ndarray:
        acc = np.zeros((2, p + 1, p + 1))
        unit = np.eye(1, p + 1)
        for mask, part in zip(masks, q):
            if not mask.any():
                acc[0] += part
                continue
            t = np.vstack([unit, now.rows(mask)])
            acc[0] += t @ part @ t.T
            m, o = np.flatnonzero(mask), np.flatnonzero(~mask)
            left = now.sigma[np.ix_(m, m)] - now.slopes(mask) @ now.sigma[np.ix_(o, m)]
            acc[1][np.ix_(m + 1, m + 1)] += part[0, 0] * left
        return acc

    total = stats.reduce(kernel, (2, p + 1, p + 1))
    return total[0], total[1][1:, 1:]


def fit_em(df: DataFrame, cols: Sequence[str], seen: Profile, max_iter: int = 100,
           stats: PatternStats | None = None) -> EMFit:
    """``iterations`` is ``max_iter + 1`` when the stopping rule was not met.

    The fill uses the parameters that entered the last round, the reported mean and covariance are
    those that left it.
    """
    stats = stats or pattern_stats(df, cols, seen)
    p, n = stats.width, float(stats.rows)
    start = stats.reduce(lambda masks, q: q.sum(axis=0), (p + 1, p + 1))
    now = NormalMap(np.zeros(p), start[1:, 1:] / n + START_RIDGE * np.eye(p))
    used, iterations = now, max_iter + 1
    for turn in range(1, max_iter + 1):
        used = now
        total, spare = expectation(stats, now)
        mu = total[0, 1:] / n
        sigma = (total[1:, 1:] - n * np.outer(mu, mu) + spare) / n
        change = max(np.abs(mu - now.mu).max(), np.abs(sigma - now.sigma).max())
        scale = max(1.0, np.abs(now.sigma).max())
        now = NormalMap(mu, sigma)
        if change / scale < TOLERANCE:
            iterations = turn
            break
    fill = AffineFill(list(cols), seen.with_gaps(cols), stats.shift, used, stats.masks if stats.on_driver else None)
    return EMFit(fill, now.mu + stats.shift, now.sigma, iterations)
