"""Filling every gap of a column with one value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import Profile, c, dbl
from gapwise.operators.quantile import exact_medians, modes


@dataclass(frozen=True)
class ConstantFill:
    """A fitted fill: one value per column, and optionally a 0/1 column per filled column."""
    values: dict[str, object]
    as_double: bool = True
    indicators: Sequence[str] = field(default_factory=tuple)

    def transform(self, df: DataFrame) -> DataFrame:
        types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
        out = {}
        for name, value in self.values.items():
            if self.as_double:
                out[name] = F.coalesce(dbl(name), F.lit(float(value)))
            else:
                out[name] = F.coalesce(c(name), F.lit(value).cast(types[name]))
        for name in self.indicators:
            out[f"{name}_missing"] = c(name).isNull().cast("int")
        return df.withColumns(out) if out else df


def fit_mean(seen: Profile, columns: Sequence[str], add_indicator: bool = False) -> ConstantFill:
    gaps = seen.with_gaps(columns)
    return ConstantFill({n: seen.columns[n].mean for n in gaps}, True, gaps if add_indicator else ())


def fit_median(df: DataFrame, seen: Profile, columns: Sequence[str], add_indicator: bool = False) -> ConstantFill:
    gaps = seen.with_gaps(columns)
    found = exact_medians(df, {n: seen.columns[n].n for n in gaps})
    return ConstantFill({n: found[n] for n in gaps}, True, gaps if add_indicator else ())


def fit_mode(df: DataFrame, seen: Profile, columns: Sequence[str], add_indicator: bool = False) -> ConstantFill:
    gaps = [n for n in seen.with_gaps(columns) if seen.columns[n].n]
    return ConstantFill(modes(df, gaps), False, gaps if add_indicator else ())


def fit_constant(seen: Profile, columns: Sequence[str], value: float, add_indicator: bool = False) -> ConstantFill:
    gaps = seen.with_gaps(columns)
    return ConstantFill({n: value for n in gaps}, True, gaps if add_indicator else ())
