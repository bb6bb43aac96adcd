"""Bagged regression trees grown from cells of binned predictors.

A bootstrap gives every row a weight per tree, drawn from its key. One pass adds up weights and weighted labels by
(tree, cell); a tree needs nothing else, so the levels cost no further pass over the rows. Every tree is grown in a
task of its own from at most MAX_CELLS cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.draws import scramble
from gapwise.operators.cuts import Cuts

MAX_CELLS = 1 << 19    # cells that one tree is grown from at most
CHUNK_ROWS = 100_000   # rows that are added up at once in a task
HELD_SUMS = 3_000_000  # sums that a task keeps before it hands them on
FRONT_NODES = 4096     # open nodes of a level that are searched at once
MEMO_CELLS = 1 << 20   # predictions of cells that a task remembers
#: Tells a real gain from rounding, as a share of all the spread between cells.
LEAST_GAIN = 1e-12


def _poisson_table() -> np.ndarray:
    """Bootstrap weight by a 16-bit draw: Poisson with mean 1, cut where less than one draw in 65,536 is left."""
    reach = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(reach, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


POISSON = _poisson_table()


def bootstrap(row_hash: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, rows) weights that depend only on the row's hash, the tree and the seed."""
    out = np.empty((4 * -(-trees // 4), len(row_hash)), dtype=np.uint8)
    for block in range(0, trees, 4):
        draws = np.ascontiguousarray(scramble(row_hash, seed, block)).view(np.uint16).reshape(-1, 4)
        out[block : block + 4] = POISSON[draws].T
    return out[:trees]


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; ``feature`` is -1 in a leaf, the second child follows the first."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        rows, at = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            at = np.where(inner, self.child[at] + (bins[rows, self.feature[at]] > self.cut[at]), at)


def grow(bins: np.ndarray, weight: np.ndarray, total: np.ndarray, radix: Sequence[int], depth: int) -> Tree:
    """Level by level, each node cut where the squared error falls most; ``total`` is the weighted sum of labels."""
    feature, cut, child, value = [-1], [0], [0], [total.sum() / weight.sum()]
    least = LEAST_GAIN * float((total**2 / weight).sum())
    node, front = np.zeros(len(weight), dtype=np.int64), [0]
    for _ in range(depth):
        by_feature, by_cut = np.full(len(front), -1), np.zeros(len(front), dtype=np.int64)
        sides = np.zeros((2, 2, len(front)))  # (weight or total, left or right, node)
        for start in range(0, len(front), FRONT_NODES):
            here = (node >= start) & (node < start + FRONT_NODES)
            at, b, w, s = node[here] - start, bins[here], weight[here], total[here]
            k = min(FRONT_NODES, len(front) - start)
            all_w, all_s, best = np.bincount(at, w, k), np.bincount(at, s, k), np.full(k, least)
            for f, r in enumerate(radix):
                if r < 2:
                    continue
                left_w = np.bincount(at * r + b[:, f], w, k * r).reshape(k, r).cumsum(axis=1)[:, :-1]
                left_s = np.bincount(at * r + b[:, f], s, k * r).reshape(k, r).cumsum(axis=1)[:, :-1]
                right_w, right_s = all_w[:, None] - left_w, all_s[:, None] - left_s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = left_s**2 / left_w + right_s**2 / right_w - (all_s**2 / all_w)[:, None]
                gain = np.where((left_w > 0) & (right_w > 0), gain, -np.inf)
                j = gain.argmax(axis=1)
                n = np.flatnonzero(gain[np.arange(k), j] > best)
                best[n] = gain[n, j[n]]
                by_feature[start + n], by_cut[start + n] = f, j[n]
                for i, (left, right) in enumerate(((left_w, right_w), (left_s, right_s))):
                    sides[i, 0, start + n], sides[i, 1, start + n] = left[n, j[n]], right[n, j[n]]
        split = np.flatnonzero(by_feature >= 0)
        if not len(split):
            break
        rank = np.full(len(front), -1)
        rank[split] = np.arange(len(split))
        following = []
        for n in split:
            own = front[n]
            feature[own], cut[own], child[own] = int(by_feature[n]), int(by_cut[n]), len(feature)
            following += [len(feature), len(feature) + 1]
            feature += [-1, -1]
            cut += [0, 0]
            child += [0, 0]
            value += [sides[1, i, n] / sides[0, i, n] for i in (0, 1)]
        go = rank[node] >= 0
        bins, weight, total, node = bins[go], weight[go], total[go], node[go]
        right = bins[np.arange(len(node)), by_feature[node]] > by_cut[node]
        node, front = 2 * rank[node] + right, following
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array(value))


class _Sums:
    """Weights and weighted labels by (tree, cell) that a task has added up so far."""

    def __init__(self, trees: int) -> None:
        self.trees = trees
        self.codes, self.sums = np.zeros(0, dtype=np.int64), np.zeros((2, trees, 0))

    def add(self, codes: np.ndarray, label: np.ndarray, weights: np.ndarray) -> None:
        own, at = np.unique(codes, return_inverse=True)
        both, place = np.unique(np.concatenate([self.codes, own]), return_inverse=True)
        sums = np.zeros((2, self.trees, len(both)))
        sums[:, :, place[: len(self.codes)]] = self.sums
        at = place[len(self.codes) :][at.ravel()]
        for t in range(self.trees):
            w = weights[t].astype(float)
            sums[0, t] += np.bincount(at, w, len(both))
            sums[1, t] += np.bincount(at, w * label, len(both))
        self.codes, self.sums = both, sums

    def hand_on(self) -> pa.RecordBatch:
        tree, at = np.nonzero(self.sums[0])
        out = pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(self.codes[at]),
                                          pa.array(self.sums[0][tree, at]), pa.array(self.sums[1][tree, at])],
                                         names=["tree", "cell", "w", "s"])
        self.codes, self.sums = np.zeros(0, dtype=np.int64), np.zeros((2, self.trees, 0))
        return out


def codes_of(bins: np.ndarray, radix: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(bins), dtype=np.int64)
    for j, r in enumerate(radix):
        out = out * r + bins[:, j]
    return out


def bins_of(codes: np.ndarray, radix: Sequence[int]) -> np.ndarray:
    out = np.empty((len(codes), len(radix)), dtype=np.int64)
    for j in reversed(range(len(radix))):
        codes, out[:, j] = np.divmod(codes, radix[j])
    return out


def fits_cells(train: DataFrame, cuts: Cuts) -> bool:
    """Whether the rows lie in at most MAX_CELLS cells (about, where the bins alone do not tell)."""
    most = math.prod(cuts.radix)
    if most <= MAX_CELLS or most >= 2**62:
        return most <= MAX_CELLS
    return cuts.binned(train).agg(F.approx_count_distinct(F.struct(*cuts.bin_names), 0.02)).first()[0] <= MAX_CELLS


@dataclass(frozen=True)
class CellForest:
    cuts: Cuts
    shift: float
    trees: list[Tree]

    @staticmethod
    def fit(train: DataFrame, cuts: Cuts, label: str, row_hash: str, trees: int, depth: int, seed: int) -> CellForest:
        inputs, radix = list(cuts.inputs), cuts.radix
        shift = float(train.agg(F.avg(label)).first()[0])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, waiting, rows = _Sums(trees), [], 0

            def settle() -> None:
                columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in waiting]) for i in range(len(inputs) + 2)]
                held.add(codes_of(cuts.bins(columns[:-2]), radix), columns[-2] - shift, bootstrap(columns[-1], trees, seed))
                waiting.clear()

            for batch in batches:
                waiting.append(batch)
                rows += batch.num_rows
                if rows >= CHUNK_ROWS:
                    settle()
                    rows = 0
                    if len(held.codes) * trees > HELD_SUMS:
                        yield held.hand_on()
            if rows:
                settle()
            yield held.hand_on()

        def one(cells: pd.DataFrame) -> pd.DataFrame:
            cells = cells.sort_values("cell")
            tree = grow(bins_of(cells["cell"].to_numpy(), radix), cells["w"].to_numpy(), cells["s"].to_numpy(), radix, depth)
            return pd.DataFrame({"tree": cells["tree"].iloc[:1], "feature": [tree.feature.tolist()], "cut": [tree.cut.tolist()],
                                 "child": [tree.child.tolist()], "value": [tree.value.tolist()]})

        sums = (train.select(*inputs, label, row_hash).mapInArrow(add_up, "tree int, cell long, w double, s double")
                .groupBy("tree", "cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")))
        grown = sums.groupBy("tree").applyInPandas(one, "tree int, feature array<int>, cut array<int>, child array<int>, value array<double>")
        return CellForest(cuts, shift, [Tree(*(np.array(r[n]) for n in ("feature", "cut", "child", "value")))
                                        for r in sorted(grown.collect(), key=lambda r: r["tree"])])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.shift + sum((t.predict(bins) for t in self.trees), np.zeros(len(bins))) / max(1, len(self.trees))

    def transform(self, df: DataFrame, prediction: str, wanted: Column) -> DataFrame:
        """Adds the mean of the trees to the rows ``wanted``; a cell's mean is figured once in a task."""
        model = df.sparkSession.sparkContext.broadcast(self)
        radix, inputs = self.cuts.radix, self.cuts.inputs
        known = math.prod(radix) <= MEMO_CELLS

        def predictions(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest, memo = model.value, np.full(math.prod(radix) if known else 0, np.nan)
            for *columns, asked in batches:
                asked = asked.to_numpy(dtype=bool)
                bins = forest.cuts.bins([v.to_numpy(dtype=float)[asked] for v in columns])
                out = np.zeros(len(asked))
                if known:
                    codes = codes_of(bins, radix)
                    new = np.unique(codes[np.isnan(memo[codes])])
                    memo[new] = forest.predict(bins_of(new, radix))
                    out[asked] = memo[codes]
                else:
                    out[asked] = forest.predict(bins)
                yield pd.Series(out)

        return df.withColumn(prediction, F.pandas_udf(predictions, "double")(*inputs, wanted))
