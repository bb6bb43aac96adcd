"""Multiple imputation: m chained imputations with draws from the predictive distribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions.draws import GOLDEN, hash_normal, mixed, scramble
from gapwise.functions.missing import Profile, all_present, any_missing, c, dbl, runs_name
from gapwise.operators.chained import fill_order
from gapwise.operators.linear import LinearFit, bayesian_ridge
from gapwise.operators.moments import WIDE, matrix_of, pattern_stats, pattern_sums, sum_arrays
from gapwise.session import StagedTable, stage, write_stage


@dataclass
class Runs:
    """All m data sets in one frame: gaps hold run 0, ``__runs_<c>`` holds the m values of a filled cell."""
    frame: DataFrame
    cols: list[str]
    gaps: list[str]
    m: int

    def _run_columns(self) -> list[str]:
        return [runs_name(n) for n in self.gaps]

    def shown(self) -> DataFrame:
        """Run 0, without the other runs."""
        return self.frame.drop(*self._run_columns())

    def run(self, i: int) -> DataFrame:
        """One complete data set."""
        fills = {n: F.coalesce(F.get(c(runs_name(n)), F.lit(i)), c(n)) for n in self.gaps}
        return self.frame.withColumns(fills).drop(*self._run_columns())

    def spread_of(self, name: str) -> Column:
        """Population spread of a cell over the runs; 0 for observed cells."""
        if name not in self.gaps:
            return F.lit(0.0)
        v = c(runs_name(name))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.lit(float(self.m))
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.lit(float(self.m))
        return F.coalesce(F.sqrt(var), F.lit(0.0))

    def spread(self, key: Sequence[str]) -> DataFrame:
        return self.frame.select(*[c(k) for k in key], *[self.spread_of(n).alias(n) for n in self.cols])

    def pooled(self) -> DataFrame:
        """(column, pooled_mean, between_sd): mean over runs and rows, spread (ddof 1) of the run means."""
        aggs, items = [], []
        for j, n in enumerate(self.cols):
            for i in range(self.m):
                value = F.coalesce(F.get(c(runs_name(n)), F.lit(i)), dbl(n)) if n in self.gaps else dbl(n)
                aggs.append(F.avg(value).alias(f"a{j}_{i}"))
            items.append(F.struct(F.lit(n).alias("column"),
                                  F.array(*[F.col(f"a{j}_{i}") for i in range(self.m)]).alias("means")))
        each = self.frame.agg(*aggs).select(F.inline(F.array(*items)))
        return (each.select("column", F.explode("means").alias("run_mean")).groupBy("column")
                .agg(F.avg("run_mean").alias("pooled_mean"), F.stddev_samp("run_mean").alias("between_sd")))


def impute_multiple(df: DataFrame, key: Sequence[str], cols: Sequence[str], seen: Profile, m: int = 5,
                    max_iter: int = 10, seed: int = 0) -> Runs:
    cols, gaps = list(cols), seen.with_gaps(cols)
    order = fill_order(cols, seen)
    if len(gaps) == 1 or len(cols) == 1:
        frame = _single_column(df, key, cols, gaps, seen, m, max_iter, seed)
    elif gaps:
        frame = _chains(df, key, cols, gaps, order, seen, m, max_iter, seed)
    else:
        frame = df
    return Runs(frame, cols, gaps, m)


def draw_salt(column: str, turn: int) -> str:
    return f"{column}:draw:{turn}"


def _single_column(df: DataFrame, key: Sequence[str], cols: Sequence[str], gaps: Sequence[str], seen: Profile,
                   m: int, max_iter: int, seed: int) -> DataFrame:
    """Predictors are complete, so the model never changes and only the last draw of each run counts."""
    if not gaps:
        return df
    name = gaps[0]
    if len(cols) == 1:
        flat = F.coalesce(dbl(name), F.lit(seen.columns[name].mean))
        runs = F.when(c(name).isNull(), F.array_repeat(F.lit(seen.columns[name].mean), m))
        return df.withColumns({runs_name(name): runs, name: flat})
    at = cols.index(name)
    stats = pattern_stats(df, cols, seen)
    side = len(cols) + 1
    fit = bayesian_ridge(stats.reduce(lambda masks, q: q[~masks[:, at]].sum(axis=0), (side, side)), at + 1)
    x = [dbl(n) - F.lit(float(stats.shift[j])) for j, n in enumerate(cols)]
    mean = F.lit(float(fit.coef[0] + stats.shift[at]))
    var = F.lit(fit.noise_var)
    for j in range(len(cols)):
        if j == at:
            continue
        mean = mean + F.lit(float(fit.coef[j + 1])) * x[j]
        left = x[j] - F.lit(float(fit.centre[j + 1]))
        for k in range(len(cols)):
            if k != at:
                var = var + F.lit(float(fit.coef_cov[j + 1, k + 1])) * left * (x[k] - F.lit(float(fit.centre[k + 1])))
    noise = [hash_normal(key, draw_salt(name, max_iter - 1), seed + i) for i in range(m)]
    runs = F.when(c(name).isNull(), F.array(*[mean + F.sqrt(var) * e for e in noise]))
    return df.withColumn(runs_name(name), runs).withColumn(
        name, F.coalesce(dbl(name), F.get(c(runs_name(name)), F.lit(0))))


def cell_normals(row_hash: np.ndarray, column: int, turn: int, run_seed: int) -> np.ndarray:
    """Standard normals that depend only on (row key, column, round, run seed)."""
    first = scramble(row_hash, run_seed, turn * 65_536 + column)
    with np.errstate(over="ignore"):
        second = mixed(first + GOLDEN)
    u1 = ((first >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    u2 = (second >> np.uint64(11)).astype(float) / 2.0**53
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2 * np.pi * u2)


@dataclass(frozen=True)
class _Draw:
    """One step of one round: column, round, and a fit per run."""
    at: int
    turn: int
    fits: tuple[LinearFit, ...]


def _advance(values: np.ndarray, miss: np.ndarray, row_hash: np.ndarray, steps: Sequence[_Draw], seed: int) -> None:
    """values: (m, rows, p) of shifted numbers, changed in place."""
    for step in steps:
        rows = np.flatnonzero(miss[:, step.at])
        if not len(rows):
            continue
        for i, fit in enumerate(step.fits):
            z = np.column_stack([np.ones(len(rows)), values[i, rows]])
            left = z - fit.centre
            left[:, 0] = 0.0
            left[:, step.at + 1] = 0.0
            sd = np.sqrt(fit.noise_var + np.einsum("ij,ij->i", left @ fit.coef_cov, left))
            values[i, rows, step.at] = z @ fit.coef + sd * cell_normals(row_hash[rows], step.at, step.turn, seed + i)


def _unpack(batch: pa.RecordBatch, p: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, missing, row hashes) of a batch with h, x0.. and, once a round is written, f0..: observed numbers as they
    are, gaps from the fills of each run, or 0 before the first round."""
    own = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    x = np.stack([own(f"x{j}") for j in range(p)], axis=1).astype(float)
    miss = np.isnan(x)
    values = np.repeat(np.where(miss, 0.0, x)[None], m, axis=0)
    for j in range(p):
        if f"f{j}" in batch.schema.names:  # the m fills of a gap; every row has m numbers
            fills = batch.column(f"f{j}").flatten().to_numpy(zero_copy_only=False).reshape(len(x), m).T
            values[:, :, j] = np.where(miss[:, j], fills, values[:, :, j])
    return values, miss, own("h")


def _fills(values: np.ndarray, miss: np.ndarray, at: int, shift: float = 0.0) -> pa.Array:
    """The m values of column ``at`` of every row; 0 where the cell is observed."""
    return _lists(np.where(miss[:, at], values[:, :, at] + shift, 0.0).T)


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def _chains(df: DataFrame, key: Sequence[str], cols: list[str], gaps: list[str], order: Sequence[int], seen: Profile,
            m: int, max_iter: int, seed: int) -> DataFrame:
    """All runs advance together: one aggregate job per (round, column), one write per round but the last.

    Only rows with gaps take part; the complete rows enter every fit through one fixed matrix. The draws depend on the
    row alone, so the result is one pass over the incomplete rows that takes all rounds again: nothing is joined.
    """
    p = len(cols)
    shift = np.array([seen.columns[n].mean for n in cols], dtype=float)
    fixed = _gram(df.where(all_present(gaps)), cols, gaps, shift)
    numbers = [(dbl(n) - F.lit(float(s))).alias(f"x{j}") for j, (n, s) in enumerate(zip(cols, shift))]
    row_hash = F.xxhash64(*[c(k).cast("string") for k in key]).alias("h")
    open_rows = stage(df.where(any_missing(gaps)).hint("rebalance"), "incomplete")
    state: StagedTable | None = None
    done: list[list[_Draw]] = []
    side = p + 1
    for turn in range(max_iter):
        frame = state.frame if state else open_rows.select(row_hash, *numbers)
        steps: list[_Draw] = []
        for at in order:

            def partial(batches: Iterator[pa.RecordBatch], at=at, steps=tuple(steps)) -> Iterator[pa.RecordBatch]:
                acc = np.zeros((m, side, side))
                for batch in batches:
                    values, miss, h = _unpack(batch, p, m)
                    _advance(values, miss, h, steps, seed)
                    keep = ~miss[:, at]
                    for i in range(m):
                        z = np.column_stack([np.ones(int(keep.sum())), values[i, keep]])
                        acc[i] += z.T @ z
                yield pa.RecordBatch.from_arrays([_lists(acc.reshape(1, -1))], names=["v"])

            moments = sum_arrays(frame.mapInArrow(partial, "v array<double>"), m * side * side)
            moments = moments.reshape(m, side, side) + fixed
            steps.append(_Draw(at, turn, tuple(bayesian_ridge(moments[i], at + 1) for i in range(m))))
        done.append(steps)
        if turn == max_iter - 1:
            break

        def settle(batches: Iterator[pa.RecordBatch], steps=tuple(steps)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, miss, h = _unpack(batch, p, m)
                _advance(values, miss, h, steps, seed)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("h", *names)], *[_fills(values, miss, j) for j in order]],
                                                 names=["h", *names, *[f"f{j}" for j in order]])

        names = [f"x{j}" for j in range(p)]
        shape = ", ".join(["h long", *[f"{n} double" for n in names], *[f"f{j} array<double>" for j in order]])
        state, last = write_stage(frame.mapInArrow(settle, shape), "runs"), state
        if last:
            last.drop()
    if state:
        state.drop()
    return _filled(df, open_rows, row_hash, numbers, cols, gaps, shift, done, m, seed)


def _filled(df: DataFrame, open_rows: DataFrame, row_hash: Column, numbers: list[Column], cols: list[str], gaps: list[str],
            shift: np.ndarray, rounds: list[list[_Draw]], m: int, seed: int) -> DataFrame:
    """The complete rows as they are, and the incomplete ones with the m values of every gap."""
    p, at = len(cols), {n: cols.index(n) for n in gaps}
    own = [f.name for f in df.schema.fields]
    kept = [f"o{i}" for i in range(len(own))]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, miss, h = _unpack(batch, p, m)
            for steps in rounds:
                _advance(values, miss, h, steps, seed)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *[_fills(values, miss, j, shift[j]) for j in at.values()]],
                                             names=[*kept, *[f"r{g}" for g in range(len(gaps))]])

    fields = [T.StructField(k, f.dataType) for k, f in zip(kept, df.schema.fields)]
    runs = [T.StructField(f"r{g}", T.ArrayType(T.DoubleType())) for g in range(len(gaps))]
    made = (open_rows.select(row_hash, *numbers, *[c(n).alias(k) for n, k in zip(own, kept)])
            .mapInArrow(fill, T.StructType(fields + runs)))
    value = {n: c(k) for n, k in zip(own, kept)}
    gap = {n: F.when(value[n].isNull(), F.col(f"r{g}")) for g, n in enumerate(gaps)}
    shown = [F.coalesce(value[n].cast("double"), F.get(gap[n], F.lit(0))).alias(n) if n in gap else value[n].alias(n) for n in own]
    filled = made.select(*shown, *[gap[n].alias(runs_name(n)) for n in gaps])
    whole = df.where(all_present(gaps)).withColumns({n: dbl(n) for n in gaps})
    return whole.unionByName(filled, allowMissingColumns=True)


def _gram(complete: DataFrame, cols: Sequence[str], gaps: Sequence[str], shift: np.ndarray) -> np.ndarray:
    side = len(cols) + 1
    if len(cols) <= WIDE:  # one pattern, and its sums need no Python
        found = pattern_sums(complete, cols, gaps, shift).collect()
        return sum((matrix_of(r, len(cols)) for r in found), np.zeros((side, side)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((side, side))
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf.to_numpy(dtype=float) - shift])
            acc += z.T @ z
        yield pd.DataFrame({"v": [acc.ravel()]})

    rows = complete.select(*[dbl(n).alias(f"x{j}") for j, n in enumerate(cols)])
    return sum_arrays(rows.mapInPandas(partial, "v array<double>"), side * side).reshape(side, side)
