"""Chained imputation: every column with gaps is predicted in turn from all others, in rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import Profile, any_missing, dbl
from gapwise.operators.affine import EXPRESSION_TERMS, AffineFill
from gapwise.operators.linear import LinearFit, bayesian_ridge
from gapwise.operators.moments import PatternStats, numeric_frame, pattern_column, pattern_stats

# Fixed value of the method: stop when no row moves by more than this share of the largest value.
STOP_SHARE = 1e-3

Step = tuple[int, np.ndarray]


@dataclass(frozen=True)
class ChainMap:
    """The affine map left by a sequence of (column, coefficients) overwrites, starting from means."""
    steps: tuple[Step, ...]

    def rows(self, mask: np.ndarray) -> np.ndarray:
        return self.history(mask, (len(self.steps),))[0]

    def history(self, mask: np.ndarray, marks: Sequence[int]) -> list[np.ndarray]:
        """Maps after each number of steps in ``marks``."""
        p = len(mask)
        t = np.vstack([np.eye(1, p + 1), np.hstack([np.zeros((p, 1)), np.diag((~mask).astype(float))])])
        out, wanted = [], list(marks)
        for k in range(len(self.steps) + 1):
            while wanted and wanted[0] == k:
                out.append(t[1:].copy())
                wanted.pop(0)
            if k < len(self.steps):
                at, coef = self.steps[k]
                if mask[at]:
                    t[at + 1] = coef @ t
        return out


def overwrite(filled: np.ndarray, masks: np.ndarray, at: int, coef: np.ndarray) -> None:
    """Update the moments of completed data, per pattern, after column ``at`` was predicted anew."""
    hit = masks[:, at]
    if hit.any():
        f = filled[hit]
        row = np.einsum("i,kij->kj", coef, f)
        f[:, at + 1, :] = row
        f[:, :, at + 1] = row
        f[:, at + 1, at + 1] = row @ coef
        filled[hit] = f


def fill_order(cols: Sequence[str], seen: Profile) -> list[int]:
    """Columns with gaps, fewest gaps first."""
    gaps = seen.with_gaps(cols)
    return sorted((cols.index(n) for n in gaps), key=lambda i: seen.columns[cols[i]].missing)


def _run(stats: PatternStats, order: Sequence[int], rounds: int,
         learner: Callable[[np.ndarray, int], LinearFit]) -> list[Step]:
    """All rounds. With patterns on the driver no job runs here at all."""
    side = stats.width + 1
    steps: list[Step] = []
    filled = stats.q.copy()
    for _ in range(rounds):
        for at in order:
            if stats.on_driver:
                m = filled[~stats.masks[:, at]].sum(axis=0)
            else:
                past = tuple(steps)

                def kernel(masks: np.ndarray, q: np.ndarray, past=past, at=at) -> np.ndarray:
                    state = q.copy()
                    for column, coef in past:
                        overwrite(state, masks, column, coef)
                    return state[~masks[:, at]].sum(axis=0)

                m = stats.reduce(kernel, (side, side))
            coef = learner(m, at + 1).coef
            overwrite(filled, stats.masks, at, coef)
            steps.append((at, coef))
    return steps


def _round_changes(chain: ChainMap, mask: np.ndarray, per_round: int) -> np.ndarray:
    """(rounds, p, p + 1): by how much each round changed the affine map of one pattern."""
    marks = range(0, len(chain.steps) + 1, per_round)
    return np.diff(np.stack(chain.history(mask, marks)), axis=0)


def largest_moves(df: DataFrame, stats: PatternStats, chain: ChainMap, per_round: int) -> np.ndarray:
    """Largest row sum of absolute changes in every round. One job over the rows with gaps."""
    cols, rounds = stats.cols, len(chain.steps) // per_round
    if stats.on_driver and int(stats.masks.sum()) * (stats.width + 1) * rounds <= 2 * EXPRESSION_TERMS:
        return _moves_by_expression(df, stats, chain, per_round, rounds)
    shift = stats.shift

    def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros(rounds)
        known: dict[bytes, np.ndarray] = {}
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            miss = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), np.where(miss, 0.0, x)])
            masks, group = np.unique(miss, axis=0, return_inverse=True)
            for k, mask in enumerate(masks):
                delta = known.get(mask.tobytes())
                if delta is None:
                    delta = _round_changes(chain, mask, per_round)
                    if len(known) < 1000:
                        known[mask.tobytes()] = delta
                rows = z[group.ravel() == k]
                for r in range(rounds):
                    best[r] = max(best[r], np.abs(rows @ delta[r].T).sum(axis=1).max())
        yield pd.DataFrame({"r": np.arange(rounds), "v": best})

    found = (numeric_frame(df.where(any_missing(cols)), cols).mapInPandas(moves, "r int, v double")
             .groupBy("r").agg(F.max("v").alias("v")).collect())
    best = np.zeros(rounds)
    for row in found:
        best[row["r"]] = row["v"]
    return best


def _moves_by_expression(df: DataFrame, stats: PatternStats, chain: ChainMap, per_round: int,
                         rounds: int) -> np.ndarray:
    cols = stats.cols
    z = [F.lit(1.0), *[F.coalesce(dbl(n) - F.lit(float(s)), F.lit(0.0)) for n, s in zip(cols, stats.shift)]]
    ragged = [n for j, n in enumerate(cols) if stats.masks[:, j].any()]
    pattern = pattern_column(ragged)
    best = [F.lit(0.0)] * rounds
    for mask in stats.masks[stats.masks.any(axis=1)]:
        text = "".join("1" if mask[cols.index(n)] else "0" for n in ragged)
        delta = _round_changes(chain, mask, per_round)
        for r in range(rounds):
            moved = sum((F.abs(sum((F.lit(float(w)) * z[j] for j, w in enumerate(row) if w != 0.0), F.lit(0.0)))
                         for row in delta[r] if row.any()), F.lit(0.0))
            best[r] = F.when(pattern == F.lit(text), moved).otherwise(best[r])
    row = df.where(any_missing(ragged)).agg(*[F.max(b).alias(f"r{i}") for i, b in enumerate(best)]).first()
    return np.array([v or 0.0 for v in row])


def fit_chained(df: DataFrame, cols: Sequence[str], seen: Profile, max_iter: int = 10,
                stats: PatternStats | None = None) -> AffineFill:
    """Bayesian ridge chain. One column alone falls back to its mean."""
    cols = list(cols)
    stats = stats or pattern_stats(df, cols, seen)
    order = fill_order(cols, seen)
    if len(cols) == 1 or not order:
        steps: list[Step] = []
    elif len(order) == 1:  # complete predictors: every round would fit the same model
        steps = _run(stats, order, 1, bayesian_ridge)
    else:
        steps = _run(stats, order, max_iter, bayesian_ridge)
        limit = STOP_SHARE * max(max(abs(seen.columns[n].low), abs(seen.columns[n].high)) for n in cols)
        moves = largest_moves(df, stats, ChainMap(tuple(steps)), len(order))
        calm = np.flatnonzero(moves < limit)
        if len(calm):
            steps = steps[: (int(calm[0]) + 1) * len(order)]
    return AffineFill(cols, seen.with_gaps(cols), stats.shift, ChainMap(tuple(steps)),
                      stats.masks if stats.on_driver else None)
