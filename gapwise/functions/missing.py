"""What "missing" means, which columns are data, and one-pass column profiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "__mask"
TRUTH_PREFIX = "__truth_"
GAPS = "__gaps"
RUNS_PREFIX = "__runs_"
_INTERNAL = (MASK, GAPS)


def c(name: str) -> Column:
    """Column by exact name; dots and spaces in names are taken literally."""
    return F.col("`" + name.replace("`", "``") + "`")


def truth_name(column: str) -> str:
    return TRUTH_PREFIX + column


def runs_name(column: str) -> str:
    return RUNS_PREFIX + column


def is_internal(name: str) -> bool:
    return name in _INTERNAL or name.startswith((TRUTH_PREFIX, RUNS_PREFIX))


def as_key(key: str | Sequence[str] | None) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def data_columns(df: DataFrame, key: str | Sequence[str] | None = None) -> list[str]:
    skip = set(as_key(key))
    return [f for f in df.columns if f not in skip and not is_internal(f)]


def numeric_columns(df: DataFrame, key: str | Sequence[str] | None = None) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [f for f in data_columns(df, key) if isinstance(types[f], T.NumericType)]


def normalise_missing(df: DataFrame) -> DataFrame:
    """NULL becomes the only missing marker: NaN in float and double columns turns into NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.nanvl(c(n), F.lit(None)) for n in floats}) if floats else df


def any_missing(columns: Iterable[str]) -> Column:
    terms = [c(n).isNull() for n in columns]
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def all_present(columns: Iterable[str]) -> Column:
    return ~any_missing(columns)


def dbl(name: str) -> Column:
    return c(name).cast("double")


def can_hold_nan(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns whose gaps cannot be read off file statistics, because NaN counts as missing too."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [n for n in columns if isinstance(types[n], (T.FloatType, T.DoubleType))]


def has_gaps(df: DataFrame, columns: Sequence[str]) -> bool:
    """Is anything missing? A pushed-down IS NULL filter: complete row groups are skipped unread."""
    return bool(columns) and not df.where(any_missing(columns)).isEmpty()


@dataclass(frozen=True)
class ColumnProfile:
    n: int
    missing: int
    mean: float | None = None
    std_pop: float | None = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Profile:
    rows: int
    columns: dict[str, ColumnProfile]

    def with_gaps(self, names: Iterable[str]) -> list[str]:
        return [n for n in names if self.columns[n].missing]

    def usable(self, names: Iterable[str]) -> list[str]:
        return [n for n in names if self.columns[n].n]

    @property
    def missing_cells(self) -> int:
        return sum(p.missing for p in self.columns.values())


def profile(df: DataFrame, columns: Sequence[str], moments: Sequence[str] = ()) -> Profile:
    """Counts for every column, and mean / spread / range for ``moments``, in a single aggregate job."""
    wanted = set(moments)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        aggs.append(F.count(c(name)).alias(f"n{i}"))
        if name in wanted:
            x = dbl(name)
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                     F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    rows = row["rows"]
    out = {}
    for i, name in enumerate(columns):
        n = row[f"n{i}"]
        extra = (row[f"m{i}"], row[f"s{i}"], row[f"l{i}"], row[f"h{i}"]) if name in wanted else ()
        out[name] = ColumnProfile(n, rows - n, *extra)
    return Profile(rows, out)
