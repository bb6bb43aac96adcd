"""Applying a fitted fill that is affine in the observed values, given the row's missing pattern."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions.missing import dbl
from gapwise.operators.moments import pattern_column

# Plain column expressions up to this many multiply-adds; above, one Arrow UDF evaluates matrices.
EXPRESSION_TERMS = 400


class FillMap(Protocol):
    """Rows of the affine map for one pattern, in shifted coordinates: (p, p + 1), constant first."""

    def rows(self, mask: np.ndarray) -> np.ndarray: ...


def affine_value(row: np.ndarray, mask: np.ndarray, cols: Sequence[str], shift: np.ndarray, at: int) -> Column:
    value = F.lit(float(row[0] + shift[at]))
    for j, name in enumerate(cols):
        if not mask[j] and row[j + 1] != 0.0:
            value = value + F.lit(float(row[j + 1])) * (dbl(name) - F.lit(float(shift[j])))
    return value


@dataclass(frozen=True)
class AffineFill:
    """Fills ``fill_cols``; ``seen`` lists the patterns of the fitted data when they are few enough to know."""
    cols: list[str]
    fill_cols: list[str]
    shift: np.ndarray
    fill_map: FillMap
    seen: np.ndarray | None = None

    def _patterns(self, seen_only: bool) -> np.ndarray | None:
        p = len(self.cols)
        if seen_only and self.seen is not None:
            masks = self.seen
        elif p <= 4:
            masks = np.array(list(itertools.product([False, True], repeat=p)))
        else:
            return None
        return masks if int(masks.sum()) * p <= EXPRESSION_TERMS else None

    def transform(self, df: DataFrame, seen_only: bool = False) -> DataFrame:
        """``seen_only`` promises that ``df`` shows no pattern beyond those of the fitted data."""
        masks = self._patterns(seen_only)
        fills = self._by_expression(masks) if masks is not None else self._by_matrix()
        return df.withColumns({n: F.coalesce(dbl(n), v) for n, v in fills.items()})

    def _by_expression(self, masks: np.ndarray) -> dict[str, Column]:
        ragged = [n for j, n in enumerate(self.cols) if masks[:, j].any()]
        pattern = pattern_column(ragged)
        index = [self.cols.index(n) for n in ragged]
        maps = [(m, self.fill_map.rows(m)) for m in masks if m.any()]
        out = {}
        for name in self.fill_cols:
            at = self.cols.index(name)
            cases = [("".join("1" if m[j] else "0" for j in index), affine_value(t[at], m, self.cols, self.shift, at))
                     for m, t in maps if m[at]]
            if not cases:
                continue
            if len(cases) == 1:
                out[name] = cases[0][1]
            else:
                value = F
                for text, expr in cases:
                    value = value.when(pattern == F.lit(text), expr)
                out[name] = value
        return out

    def _by_matrix(self) -> dict[str, Column]:
        shift, fill_map = self.shift, self.fill_map
        at = [self.cols.index(n) for n in self.fill_cols]
        schema = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(len(at))])

        def evaluate(*series: pd.Series) -> pd.DataFrame:
            x = np.column_stack([s.to_numpy(dtype=float) for s in series]) - shift
            miss = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), np.where(miss, 0.0, x)])
            out = np.full((len(x), len(at)), np.nan)
            masks, group = np.unique(miss, axis=0, return_inverse=True)
            for k, mask in enumerate(masks):
                if mask.any():
                    rows = np.flatnonzero(group.ravel() == k)
                    out[rows] = z[rows] @ fill_map.rows(mask)[at].T + shift[at]
            return pd.DataFrame(out, columns=[f"f{i}" for i in range(len(at))])

        filled = F.pandas_udf(evaluate, schema)(*[dbl(n) for n in self.cols])
        return {n: filled.getField(f"f{i}") for i, n in enumerate(self.fill_cols)}
