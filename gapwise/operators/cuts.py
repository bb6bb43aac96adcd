"""Binned predictors: cut points per column, and training rows brought down to one row per cell of bins.

Tree learners with binned splits see of a predictor only its bin, so all rows of a cell (one bin per predictor) go the
same way in every tree. Their number is bounded by the bins, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SAMPLE = 10_000  # rows that place the cuts, or the square of the bins if that is more: Spark ML's own rule


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to equal counts if there are too many."""
    value, count = np.unique(values, return_counts=True)
    middles, below = (value[:-1] + value[1:]) / 2, np.cumsum(count)
    if len(middles) <= bins - 1:
        return middles
    stride, aim, out = len(values) / bins, len(values) / bins, []
    for i in range(1, len(value)):
        if abs(below[i - 1] - aim) < abs(below[i] - aim):
            out.append(middles[i - 1])
            aim += stride
    return np.array(out)


@dataclass(frozen=True)
class Cuts:
    """Cut points of each input; a value on a cut lies below it."""
    inputs: tuple[str, ...]
    at: tuple[np.ndarray, ...]

    @property
    def radix(self) -> list[int]:
        return [len(cuts) + 1 for cuts in self.at]

    def bins(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, v, side="left") for cuts, v in zip(self.at, values)], axis=1)

    def binned(self, df: DataFrame) -> DataFrame:
        """Adds the bin numbers as ``bin_names``, without leaving the JVM."""
        many = [i for i, cuts in enumerate(self.at) if len(cuts)]
        df = df.withColumns({self.bin_names[i]: F.lit(0.0) for i, cuts in enumerate(self.at) if not len(cuts)})
        if not many:
            return df
        splits = [[-np.inf, *np.nextafter(self.at[i], np.inf).tolist(), np.inf] for i in many]
        df = Bucketizer(splitsArray=splits, inputCols=[self.inputs[i] for i in many],
                        outputCols=[self.bin_names[i] for i in many]).transform(df)
        # a sum has no column metadata: a Bucketizer's output would be taken for categories, not for ordered numbers
        return df.withColumns({self.bin_names[i]: F.col(self.bin_names[i]) + F.lit(0.0) for i in many})

    @property
    def bin_names(self) -> list[str]:
        return [f"__bin{i}" for i in range(len(self.inputs))]


def place_cuts(train: DataFrame, inputs: Sequence[str], rows: int, bins: int, seed: int) -> Cuts:
    """Cuts of every input from a sample of bounded size (of all rows where there are no more). One group per input."""
    wanted = max(bins * bins, LEAST_SAMPLE)
    sample = train.select(*inputs)
    if rows > wanted:
        sample = sample.sample(wanted / rows, seed)
    most = max(2, min(bins, rows))

    def cuts(column: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": column["i"].iloc[:1], "cuts": [cut_points(column["v"].to_numpy(), most).tolist()]})

    found = (sample.select(F.posexplode(F.array(*inputs)).alias("i", "v")).groupBy("i")
             .applyInPandas(cuts, "i int, cuts array<double>").collect())
    by_input = {r["i"]: np.array(r["cuts"], dtype=float) for r in found}
    return Cuts(tuple(inputs), tuple(by_input.get(i, np.zeros(0)) for i in range(len(inputs))))
