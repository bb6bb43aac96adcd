"""Regression imputation: one least-squares model per column with gaps, predictors mean-filled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.draws import hash_normal
from gapwise.functions.missing import Profile, dbl
from gapwise.operators.linear import LinearFit, least_squares
from gapwise.operators.moments import PatternStats, centred, pattern_stats


def noise_salt(column: str) -> str:
    """The noise has draws of its own: a mask made with the same seed must not tell anything about it."""
    return f"{column}:noise"


@dataclass(frozen=True)
class RegressionFill:
    cols: list[str]
    shift: np.ndarray
    fits: dict[str, LinearFit]
    noise_key: tuple[str, ...] = ()
    seed: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for name, fit in self.fits.items():
            at = self.cols.index(name)
            value = F.lit(float(fit.coef[0] + self.shift[at]))
            for j, other in enumerate(self.cols):
                if fit.coef[j + 1] != 0.0:
                    value = value + F.lit(float(fit.coef[j + 1])) * centred(other, self.shift[j])
            if self.noise_key:
                value = value + F.lit(fit.residual_sd) * hash_normal(self.noise_key, noise_salt(name), self.seed)
            out[name] = F.coalesce(dbl(name), value)
        return df.withColumns(out) if out else df


def observed_moments(stats: PatternStats, at: int) -> np.ndarray:
    """Moments over the rows where column ``at`` is present, every other gap sitting at its mean."""
    side = stats.width + 1
    return stats.reduce(lambda masks, q: q[~masks[:, at]].sum(axis=0), (side, side))


def fit_regression(df: DataFrame, cols: Sequence[str], seen: Profile, stochastic: bool = False,
                   key: Sequence[str] = (), seed: int = 0) -> RegressionFill:
    cols = list(cols)
    stats = pattern_stats(df, cols, seen)
    fits = {}
    for name in seen.with_gaps(cols):
        at = cols.index(name)
        if len(cols) < 2 or seen.columns[name].n < 2:
            fits[name] = LinearFit(at + 1, np.zeros(len(cols) + 1))  # the mean, and no noise
        else:
            fits[name] = least_squares(observed_moments(stats, at), at + 1)
    return RegressionFill(cols, stats.shift, fits, tuple(key) if stochastic else (), seed)
