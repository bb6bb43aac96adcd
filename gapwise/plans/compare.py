"""The same gaps, several methods, one error each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import as_key, c, data_columns, dbl, normalise_missing, numeric_columns, profile
from gapwise.operators.affine import AffineFill
from gapwise.operators.simple import ConstantFill
from gapwise.plans.registry import impute
from gapwise.plans.report import finite, rmse_value

KEPT, FILLED = "__truth_kept", "__truth_filled_"  # of the internal names, so no method takes them for data


def compare_methods(masked: DataFrame, key: str | Sequence[str], target: str,
                    methods: dict[str, tuple[str, dict]], seed: int = 0, persist: bool = True) -> DataFrame:
    """(label, rmse, mean, std) per method on one masked frame (from ``inject_missing``).

    ``methods`` maps a label to (method, parameters). One profile serves all fits, and fills that are column expressions
    become columns of one frame and figures of one aggregate; other methods take a pass each. The frame is read many times, so it is kept in
    memory, or on disk where memory is short; a lost block is simply computed again. The result is one
    small row per method, computed here, so the kept frame is released on return.
    """
    key = as_key(key)
    spark = masked.sparkSession
    masked = normalise_missing(masked)
    if persist:
        masked = masked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        columns = data_columns(masked, key)
        seen = profile(masked, columns, numeric_columns(masked, key))
        alone = seen.with_gaps(columns) == [target]
        results = {label: impute(masked, method, params, seed, key, seen=seen) for label, (method, params) in methods.items()}
        wide, fused, found = masked, [], {}
        for label, result in results.items():
            name = f"{FILLED}{len(fused)}"
            model = result.extras.get("model")
            if alone and isinstance(model, (AffineFill, ConstantFill)):
                # a fill by expression: the column as this method leaves it, beside the others
                known = {"seen_only": True} if isinstance(model, AffineFill) else {}
                made = model.transform(wide.withColumn(KEPT, c(target)), **known)
                wide = made.withColumns({name: dbl(target), target: c(KEPT)}).drop(KEPT)
                fused.append(label)
            else:
                found[label] = result.frame.agg(*_figures(target, target, "")).first()
        if fused:
            row = wide.agg(*[f for i in range(len(fused)) for f in _figures(target, f"{FILLED}{i}", str(i))]).first()
            found |= {label: tuple(row[3 * i:3 * i + 3]) for i, label in enumerate(fused)}
    finally:
        if persist:
            masked.unpersist()
    return spark.createDataFrame([(label, *found[label]) for label in methods], "label string, rmse double, mean double, std double")


def _figures(target: str, filled: str, tag: str) -> list[Column]:
    x = dbl(filled)
    return [finite(v).alias(name + tag) for name, v in (("rmse", rmse_value(target, filled)), ("mean", F.avg(x)), ("std", F.stddev_samp(x)))]
