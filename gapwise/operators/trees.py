"""Chained imputation with distributed tree ensembles, on cells of binned predictors where these are few."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark import ml
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import Profile, c, dbl
from gapwise.operators.chained import STOP_SHARE, fill_order
from gapwise.operators.cuts import Cuts, place_cuts
from gapwise.operators.forest import CellForest, fits_cells
from gapwise.operators.incomplete import ROW, fill_name, join_fills, split_rows
from gapwise.session import shared_dir, tasks_for, write_stage

TRAIN_ROWS = 500_000  # training rows per partition
BOOST_BINS = 255
LEAF_ROWS = 20        # rows in a leaf of a boosted tree at least

FEATURES, LABEL, PREDICTION = "__features", "__label", "__prediction"
WEIGHT, ROW_HASH = "__weight", "__hash"


class Model(Protocol):
    def transform(self, df: DataFrame, prediction: str, wanted: Column) -> DataFrame:
        """Adds a column ``prediction``; rows that are not ``wanted`` may hold anything in it."""


#: (training rows with inputs, label and key columns; inputs; key columns; about how many rows) -> model
Learner = Callable[[DataFrame, Sequence[str], Sequence[str], int], Model]


@dataclass(frozen=True)
class SparkModel:
    """A Spark ML model on the inputs, or on their bins."""
    model: ml.Model
    inputs: list[str]
    cuts: Cuts | None = None

    def transform(self, df: DataFrame, prediction: str, wanted: Column) -> DataFrame:
        df = self.cuts.binned(df) if self.cuts else df
        return self.model.transform(_assembled(df, self.inputs)).withColumnRenamed(PREDICTION, prediction)


def random_forest(trees: int, seed: int, max_depth: int = 10, max_bins: int = 64) -> Learner:
    """Bagged regression trees that may use every column at every split.

    With few predictors the rows lie in few cells of bins: then the bootstrap weights are added up by cell in one pass and
    the trees are grown from the sums. Otherwise Spark ML grows them level by level over the rows, spread by key; it
    exchanges statistics per open node, twice as many with every level, which the depth bounds.
    """

    def learn(train: DataFrame, inputs: Sequence[str], key: Sequence[str], rows: int) -> Model:
        cuts = place_cuts(train, inputs, rows, max_bins, seed)
        if fits_cells(train, cuts):
            own = F.xxhash64(*[c(k).cast("string") for k in key]) if key else F.monotonically_increasing_id()
            return CellForest.fit(train.withColumn(ROW_HASH, own), cuts, LABEL, ROW_HASH, trees, max_depth, seed)
        forest = RandomForestRegressor(
            featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, numTrees=trees, maxDepth=max_depth,
            featureSubsetStrategy="all", maxBins=max_bins, seed=seed, maxMemoryInMB=1024)
        return SparkModel(forest.fit(_assembled(_spread(train, key, rows), inputs).select(FEATURES, LABEL)), list(inputs))

    return learn


def boosted_trees(seed: int, rounds: int = 50) -> Learner:
    """Least-squares boosting: 50 rounds, step 0.1, small trees with at least 20 rows per leaf.

    Squared errors inside a cell of bins are the same for every tree, so a cell takes part as one row: its mean label,
    weighted by its rows. The rounds run on the cells, and only binning passes over all rows.
    """

    def learn(train: DataFrame, inputs: Sequence[str], key: Sequence[str], rows: int) -> Model:
        shared_dir(train.sparkSession)  # boosting cuts its own lineage there
        cuts = place_cuts(train, inputs, rows, BOOST_BINS, seed)
        names = cuts.bin_names
        cells = write_stage(cuts.binned(train).groupBy(*names).agg(F.avg(LABEL).alias(LABEL), F.count(F.lit(1)).cast("double").alias(WEIGHT))
                            .sortWithinPartitions(*names), "cells")
        total = cells.frame.agg(F.sum(WEIGHT)).first()[0] or 0.0
        least = {"minWeightFractionPerNode": (LEAF_ROWS - 0.5) / total, "maxDepth": 5} if total >= 2 * LEAF_ROWS else {"maxDepth": 0}
        boosted = GBTRegressor(
            featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, weightCol=WEIGHT, maxIter=rounds, stepSize=0.1,
            maxBins=BOOST_BINS, seed=seed, checkpointInterval=10, maxMemoryInMB=1024, **least)
        model = boosted.fit(_assembled(cells.frame, names).select(FEATURES, LABEL, WEIGHT))
        cells.drop()
        return SparkModel(model, names, cuts)

    return learn


def _spread(train: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Even, key-ordered partitions of the (numeric, narrow) training set.

    Spark ML passes over it dozens of times, so one shuffle pays, and sampling inside the learner then
    sees the same rows in the same order however the input was laid out. The key is unique: no hot spot.
    """
    parts = tasks_for(train.sparkSession, rows, TRAIN_ROWS)
    if not key:
        return train.repartition(parts)
    return train.repartition(parts, *[c(k) for k in key]).sortWithinPartitions(*[c(k) for k in key])


def _assembled(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol=FEATURES).transform(df)


def impute_trees(df: DataFrame, key: Sequence[str], cols: Sequence[str], seen: Profile, learn: Learner,
                 max_iter: int) -> DataFrame:
    cols = list(cols)
    gaps = seen.with_gaps(cols)
    means = {n: seen.columns[n].mean for n in gaps}
    order = fill_order(cols, seen)
    if not gaps:
        return df
    if len(cols) == 1:
        return df.withColumns({n: F.coalesce(dbl(n), F.lit(means[n])) for n in gaps})
    if len(order) == 1:
        return _single_column(df, key, cols, order[0], learn, seen)
    return _rounds(df, key, cols, gaps, means, order, learn, max_iter, seen)


def _single_column(df: DataFrame, key: Sequence[str], cols: Sequence[str], at: int, learn: Learner,
                   seen: Profile) -> DataFrame:
    """Complete predictors: every round would train the same model, so one training is the answer."""
    target = cols[at]
    inputs = [f"__in{i}" for i in range(len(cols)) if i != at]
    wide = df.withColumns({f"__in{i}": dbl(n) for i, n in enumerate(cols) if i != at})
    known = wide.where(c(target).isNotNull()).select(*[c(k) for k in key], *inputs, dbl(target).alias(LABEL))
    model = learn(known, inputs, key, seen.columns[target].n)
    scored = model.transform(wide, PREDICTION, c(target).isNull())
    return (scored.withColumn(target, F.coalesce(dbl(target), F.col(PREDICTION)))
            .select(*[c(n) for n in df.columns]))


def _rounds(df: DataFrame, key: Sequence[str], cols: Sequence[str], gaps: Sequence[str], means: dict[str, float],
            order: Sequence[int], learn: Learner, max_iter: int, seen: Profile) -> DataFrame:
    """Rounds over several columns. Only rows with gaps are rewritten; complete rows are written once, before the first
    round, and read as they are by every training."""
    complete, incomplete = split_rows(df, gaps)
    inputs = [f"x{i}" for i in range(len(cols))]
    missing = [f"m{i}" for i in range(len(cols))]
    ids = [f"k{i}" for i in range(len(key))]
    named = [c(k).alias(i) for k, i in zip(key, ids)]
    whole = write_stage(complete.select(*named, *[dbl(n).alias(x) for n, x in zip(cols, inputs)]), "complete")
    table = write_stage(incomplete.select(
        ROW, *named, *[F.coalesce(dbl(n), F.lit(means.get(n, 0.0))).alias(x) for n, x in zip(cols, inputs)],
        *[c(n).isNull().alias(m) for n, m in zip(cols, missing)]), "round")
    limit = STOP_SHARE * max(max(abs(seen.columns[n].low), abs(seen.columns[n].high)) for n in cols)
    for _ in range(max_iter):
        state, before = table.frame, [f"p{i}" for i in order]
        now = state.select(ROW, *ids, *inputs, *missing).withColumns({f"p{i}": F.col(f"x{i}") for i in order})
        for at in order:
            others = [x for i, x in enumerate(inputs) if i != at]
            rows = whole.frame.unionByName(now.where(~F.col(missing[at])).select(*ids, *inputs))
            model = learn(rows.select(*ids, *others, F.col(inputs[at]).alias(LABEL)), others, ids, seen.columns[cols[at]].n)
            now = (model.transform(now, PREDICTION, F.col(missing[at]))
                   .withColumn(inputs[at], F.when(F.col(missing[at]), F.col(PREDICTION)).otherwise(F.col(inputs[at])))
                   .select(ROW, *ids, *inputs, *missing, *before))
        table, last = write_stage(now, "round"), table
        last.drop()
        state = table.frame
        moved = sum((F.abs(F.col(f"x{i}") - F.col(f"p{i}")) for i in order), F.lit(0.0))
        if (state.agg(F.max(moved)).first()[0] or 0.0) < limit:
            break
    whole.drop()
    fills = table.frame.select(ROW, *[F.col(f"x{cols.index(n)}").alias(fill_name(i)) for i, n in enumerate(gaps)])
    return join_fills(complete, incomplete, fills, gaps, means)
