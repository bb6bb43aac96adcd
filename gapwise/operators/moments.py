"""Missing-pattern statistics: the one aggregate behind regression, chained models and EM.

Rows are grouped by which columns are missing. Per group we keep Q, the sum of z z' with
z = [1, x - shift], gaps entered as 0. Any method that fills a row with an affine function of its
observed values, the same for all rows of a pattern, can be fitted from these small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import Profile, all_present, any_missing, c, dbl

# More columns than this: cross products per partition in numpy instead of one wide aggregate.
WIDE = 12
# Bounds on what may come back to the driver; beyond them every step runs as a job on the executors.
MAX_PATTERNS = 4096
MAX_CELLS = 1_000_000

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pattern_column(gap_columns: Sequence[str]) -> Column:
    """One character per column with gaps, '1' where the value is missing."""
    if not gap_columns:
        return F.lit("")
    return F.concat(*[F.when(c(n).isNull(), F.lit("1")).otherwise(F.lit("0")) for n in gap_columns])


def centred(name: str, shift: float) -> Column:
    return F.coalesce(dbl(name) - F.lit(float(shift)), F.lit(0.0))


def pattern_sums(df: DataFrame, cols: Sequence[str], gap_columns: Sequence[str],
                 shift: Sequence[float]) -> DataFrame:
    """(pattern, n, s_i, q_i_j): sums and cross products of the shifted columns, one row per pattern."""
    z = df.select(pattern_column(gap_columns).alias("pattern"),
                  *[centred(n, s).alias(f"z{i}") for i, (n, s) in enumerate(zip(cols, shift))])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(f"z{i}").alias(f"s_{i}") for i in range(len(cols))]
    aggs += [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q_{i}_{j}")
             for i in range(len(cols)) for j in range(i, len(cols))]
    return z.groupBy("pattern").agg(*aggs)


def batch_patterns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(masks, Q) of a block of shifted rows with NaN gaps."""
    miss = np.isnan(x)
    z = np.column_stack([np.ones(len(x)), np.where(miss, 0.0, x)])
    masks, group = np.unique(miss, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    edges = np.searchsorted(group.ravel()[order], np.arange(len(masks) + 1))
    blocks = [z[order[a:b]] for a, b in zip(edges[:-1], edges[1:])]
    return masks, np.stack([b.T @ b for b in blocks]) if blocks else np.zeros((0, z.shape[1], z.shape[1]))


def numeric_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[dbl(n).alias(f"x{i}") for i, n in enumerate(cols)])


def sum_arrays(df: DataFrame, size: int) -> np.ndarray:
    """Element-wise sum of a column ``v`` of equally long arrays; only ``size`` numbers reach the driver."""
    rows = (df.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


@dataclass
class PatternStats:
    """Moments by pattern. ``reduce`` evaluates an additive kernel over all patterns.

    With few patterns (the usual case) masks and matrices sit on the driver and a kernel is plain
    numpy. With too many, the driver keeps only the matrix of the complete rows and a kernel runs as
    one job over the incomplete rows, each task working on the patterns of its own batches.
    """
    cols: list[str]
    shift: np.ndarray
    rows: int
    masks: np.ndarray
    q: np.ndarray
    incomplete: DataFrame | None = None

    @property
    def on_driver(self) -> bool:
        return self.incomplete is None

    @property
    def width(self) -> int:
        return len(self.cols)

    def reduce(self, kernel: Kernel, shape: tuple[int, ...]) -> np.ndarray:
        total = kernel(self.masks, self.q) if len(self.masks) else np.zeros(shape)
        if self.incomplete is not None:
            shift = self.shift

            def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                acc = None
                for pdf in batches:
                    part = kernel(*batch_patterns(pdf.to_numpy(dtype=float) - shift))
                    acc = part if acc is None else acc + part
                if acc is not None:
                    yield pd.DataFrame({"v": [acc.ravel()]})

            size = int(np.prod(shape))
            total = total + sum_arrays(self.incomplete.mapInPandas(partial, "v array<double>"), size).reshape(shape)
        return total


def matrix_of(row, p: int) -> np.ndarray:
    q = np.zeros((p + 1, p + 1))
    q[0, 0] = row["n"]
    for i in range(p):
        q[0, i + 1] = q[i + 1, 0] = row[f"s_{i}"]
        for j in range(i, p):
            q[i + 1, j + 1] = q[j + 1, i + 1] = row[f"q_{i}_{j}"]
    return q


def _wide_sums(df: DataFrame, cols: Sequence[str], shift: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Same sums for wide tables: each partition adds up its patterns, Spark adds up the partitions."""
    p = len(cols)
    upper = np.triu_indices(p + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[bytes, np.ndarray] = {}
        for pdf in batches:
            masks, q = batch_patterns(pdf.to_numpy(dtype=float) - shift)
            for mask, part in zip(masks, q):
                name = mask.tobytes()
                acc[name] = acc[name] + part if name in acc else part
        names = ["".join("1" if m else "0" for m in np.frombuffer(k, dtype=bool)) for k in acc]
        yield pd.DataFrame({"pattern": names, "v": [q[upper] for q in acc.values()]})

    parts = numeric_frame(df, cols).mapInPandas(partial, "pattern string, v array<double>")
    sums = (parts.select("pattern", F.posexplode("v").alias("i", "v")).groupBy("pattern", "i")
            .agg(F.sum("v").alias("v")).groupBy("pattern")
            .agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("cells")))
    out = []
    for r in sums.collect():
        q = np.zeros((p + 1, p + 1))
        q[upper] = [cell["v"] for cell in r["cells"]]
        out.append((r["pattern"], q + np.triu(q, 1).T))
    return out


def _complete_matrix(df: DataFrame, cols: Sequence[str], shift: np.ndarray) -> np.ndarray:
    p = len(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((p + 1, p + 1))
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf.to_numpy(dtype=float) - shift])
            acc += z.T @ z
        yield pd.DataFrame({"v": [acc.ravel()]})

    whole = numeric_frame(df.where(all_present(cols)), cols).mapInPandas(partial, "v array<double>")
    return sum_arrays(whole, (p + 1) ** 2).reshape(p + 1, p + 1)


def pattern_stats(df: DataFrame, cols: Sequence[str], seen: Profile, max_patterns: int = MAX_PATTERNS,
                  max_cells: int = MAX_CELLS) -> PatternStats:
    """Collect the moments if the number of patterns is within bounds, else leave them distributed."""
    cols = list(cols)
    p = len(cols)
    gaps = seen.with_gaps(cols)
    shift = np.array([seen.columns[n].mean for n in cols], dtype=float)
    cap = max(1, min(max_patterns, max_cells // (p + 1) ** 2))
    if 2 ** min(len(gaps), 60) > cap:  # the profile alone cannot bound the number of patterns: count them
        found = df.groupBy(pattern_column(gaps).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
        if len(found.limit(cap + 1).collect()) > cap:
            complete = _complete_matrix(df, cols, shift)
            return PatternStats(cols, shift, seen.rows, np.zeros((1, p), dtype=bool), complete[None],
                                numeric_frame(df.where(any_missing(gaps)), cols))
    if p > WIDE:
        found = _wide_sums(df, cols, shift)
        masks = np.array([[ch == "1" for ch in name] for name, _ in found], dtype=bool).reshape(len(found), p)
        return PatternStats(cols, shift, seen.rows, masks, np.stack([q for _, q in found]))
    rows = sorted(pattern_sums(df, cols, gaps, shift).collect(), key=lambda r: r["pattern"])
    masks = np.zeros((len(rows), p), dtype=bool)
    for k, r in enumerate(rows):
        for g, ch in zip(gaps, r["pattern"]):
            masks[k, cols.index(g)] = ch == "1"
    return PatternStats(cols, shift, seen.rows, masks, np.stack([matrix_of(r, p) for r in rows]))
