"""What a method did: statistics before and after, error, histogram, correlations, cells and rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.errors import EngineError
from gapwise.functions.correlation import correlation_matrix
from gapwise.functions.missing import (GAPS, MASK, any_missing, as_key, c, can_hold_nan, data_columns, dbl, has_gaps,
                                       is_internal, normalise_missing, numeric_columns, profile, runs_name, truth_name)
from gapwise.operators.inject import inject_missing, resolve_missing
from gapwise.plans.registry import Result, impute

# Fixed values of the report: rows shown, histogram bins.
SHOWN_ROWS = 200
BINS = 20


def finite(x: Column) -> Column:
    """Numbers a report may show: NaN and the infinities become NULL."""
    ok = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(ok, x)


def describe_aggregates(x: Column, tag: str) -> list[Column]:
    return [F.count(x).alias(f"{tag}n"), F.avg(x).alias(f"{tag}mean"), F.stddev_samp(x).alias(f"{tag}std"),
            F.min(x).alias(f"{tag}min"), F.max(x).alias(f"{tag}max")]


def _described(tag: str, side: str) -> list[Column]:
    """The five statistics of one column, read from ``describe_aggregates`` and named after a side."""
    return [F.col(f"{tag}n").alias(f"{side}_n"),
            *[finite(F.col(tag + s)).alias(f"{side}_{s}") for s in ("mean", "std", "min", "max")]]


def describe(df: DataFrame, columns: Sequence[str], values: dict[str, Column] | None = None) -> DataFrame:
    """(column, n, mean, std, min, max) over observed values; one aggregate for all columns."""
    values = values or {}
    aggs, items = [], []
    for i, name in enumerate(columns):
        tag = f"c{i}_"
        aggs += describe_aggregates(values.get(name, dbl(name)), tag)
        items.append(F.struct(F.lit(name).alias("column"), F.col(f"{tag}n").alias("n"),
                              *[finite(F.col(tag + s)).alias(s) for s in ("mean", "std", "min", "max")]))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing, rows) for every column in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(c(n).isNull()).alias(f"m{i}") for i, n in enumerate(columns)]
    items = [F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias("missing"), F.col("rows").alias("rows"))
             for i, n in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def rmse_value(column: str, filled: str | None = None) -> Column:
    """Aggregate: root mean square error over the removed cells; NULL if there is none or one is still empty.

    ``filled`` names the column that holds the filled values, if it is another one.
    """
    hit, filled = c(MASK), filled or column
    error = F.pow(dbl(filled) - c(truth_name(column)), F.lit(2.0))
    return F.when(F.count_if(hit & c(filled).isNull()) == 0, F.sqrt(F.avg(F.when(hit, error))))


def rmse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rmse) for columns whose truth travels in the frame."""
    aggs = [rmse_value(n).alias(f"e{i}") for i, n in enumerate(columns)]
    items = [F.struct(F.lit(n).alias("column"), finite(F.col(f"e{i}")).alias("rmse")) for i, n in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def align_truth(filled: DataFrame, truth: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Bring the truth in by row key when it did not travel as a column; rows that left stay out."""
    side = truth.select(*[c(k) for k in key], dbl(column).alias(truth_name(column)))
    return filled.join(side, list(key), "inner")


def relative_deviation(after: Column, reference: Column) -> Column:
    """Percent change against a reference; NULL where the reference is 0 or unknown."""
    return F.try_divide(after - reference, F.abs(reference)) * F.lit(100.0)


def shared_histogram(series: dict[str, tuple[DataFrame, Column]], bins: int = BINS) -> DataFrame | None:
    """(series, bin, low, high, n): equal bins between the joint minimum and maximum, last bin closed.

    One small aggregate per source for the range, one grouped count, and empty bins added back.
    ``None`` if no series has a value.
    """
    frames: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, value) in series.items():
        frames.setdefault(id(df), (df, []))[1].append((name, value))
    low = high = None
    alive = []
    for df, parts in frames.values():
        aggs = [a for i, (_, v) in enumerate(parts) for a in (F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"))]
        row = df.agg(*aggs).first()
        for i, (name, _) in enumerate(parts):
            if row[f"l{i}"] is not None:
                alive.append(name)
                low = row[f"l{i}"] if low is None else min(low, row[f"l{i}"])
                high = row[f"h{i}"] if high is None else max(high, row[f"h{i}"])
    if low is None:
        return None
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    edge = lambda b: F.lit(low) + b * F.lit(step)
    counted = None
    for df, parts in frames.values():
        pairs = F.array(*[F.struct(F.lit(n).alias("series"), v.alias("v")) for n, v in parts])
        rows = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
        guess = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))), F.lit(bins - 1))
        rows = rows.withColumn("b", guess.cast("int"))
        # a value that rounding put next to its bin moves to the bin whose edges hold it
        down = (F.col("v") < edge(F.col("b"))).cast("int")
        up = ((F.col("v") >= edge(F.col("b") + 1)) & (F.col("b") != F.lit(bins - 1))).cast("int")
        part = rows.select("series", (F.col("b") - down + up).alias("bin")).groupBy("series", "bin").count()
        counted = part if counted is None else counted.unionByName(part)
    names = F.array(*[F.lit(n) for n in series if n in alive])
    grid = (counted.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.explode(names).alias("series")))
    upper = F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(edge(F.col("bin") + 1))
    return (grid.join(counted, ["series", "bin"], "left")
            .select("series", "bin", edge(F.col("bin")).alias("low"), upper.alias("high"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("n")))


def head(df: DataFrame, key: Sequence[str], limit: int = SHOWN_ROWS) -> DataFrame:
    """The rows with the smallest keys; a top-k, not a full sort."""
    return df.orderBy(*[c(k) for k in key]).limit(limit)


def gaps_first(df: DataFrame, key: Sequence[str], limit: int = SHOWN_ROWS) -> DataFrame:
    """The shown rows, those with a gap first; ``position`` is the place on the screen."""
    gap = any_missing(data_columns(df, key))
    order = Window.orderBy(F.desc("__has_gap"), *[c(k) for k in key])  # over ``limit`` rows only
    return (head(df, key, limit).withColumn("__has_gap", gap)
            .withColumn("position", F.row_number().over(order)).drop("__has_gap"))


def dropped_rows(before: DataFrame, after: DataFrame, key: Sequence[str], limit: int | None = SHOWN_ROWS) -> DataFrame:
    """Keys that a method removed: among the shown rows, or everywhere with ``limit=None``."""
    keys = [c(k) for k in key]
    shown = before.select(*keys) if limit is None else head(before.select(*keys), key, limit)
    return shown.join(after.select(*keys), list(key), "left_anti")


def surviving_gap_rows(before: DataFrame, after: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Rows with a gap in ``column`` that are still there afterwards."""
    gaps = before.where(c(column).isNull()).select(*[c(k) for k in key])
    return gaps.join(after.select(*[c(k) for k in key]), list(key), "left_semi")


def imputed_cells(tracked: DataFrame, key: Sequence[str], limit: int | None = None) -> DataFrame:
    """(key.., column, value, text, truth, sd): cells that were missing and are filled now.

    Needs ``__gaps`` (see ``impute(track=True)``); no join. ``value`` is for numbers, ``text`` for any type.
    """
    rows = head(tracked, key, limit) if limit is not None else tracked
    numeric, present = set(numeric_columns(tracked, key)), set(tracked.columns)
    columns = [n for n in tracked.columns if n not in key and not is_internal(n)]

    def pick(values: dict[str, Column], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for n, value in values.items():
            out = F.when(F.col("column") == F.lit(n), value).otherwise(out)
        return out

    holes = rows.withColumn("column", F.explode(c(GAPS)))  # rows without a gap vanish here
    cells = holes.select(
        *[c(k) for k in key], "column",
        pick({n: dbl(n) for n in columns if n in numeric}, "double").alias("value"),
        pick({n: c(n).cast("string") for n in columns}, "string").alias("text"),
        pick({n: c(truth_name(n)) for n in columns if truth_name(n) in present}, "double").alias("truth"),
        pick({n: _array_sd(c(runs_name(n))) for n in columns if runs_name(n) in present}, "double").alias("sd"))
    return cells.where(F.col("text").isNotNull())


def _array_sd(v: Column) -> Column:
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def shapes(df: DataFrame, key: Sequence[str]) -> tuple[int, int]:
    return df.count(), len(data_columns(df, key))


@dataclass
class Report:
    """Parts are DataFrames, built on demand; nothing is computed until one is used."""
    before: DataFrame
    after: DataFrame
    key: list[str]
    column: str
    has_truth: bool
    has_native_missing: bool
    missing_applied: dict | None
    numeric_columns: list[str]
    notes: list[str] = field(default_factory=list)
    extras: dict = field(default_factory=dict)

    @property
    def _target(self) -> str | None:
        return self.missing_applied["target"] if self.missing_applied else None

    def _kept(self) -> list[str]:
        return [n for n in self.numeric_columns if n in self.after.columns]

    def _truth(self) -> dict[str, Column]:
        return {self._target: c(truth_name(self._target))} if self.has_truth else {}

    def stats(self) -> DataFrame:
        """One row per numeric column: gaps, before / after / truth statistics, rmse and deviation in percent.

        Two aggregates in all: one over the data before, one over the data after.
        """
        truth, kept, names = self._truth(), self._kept(), self.numeric_columns
        first, second = [F.count(F.lit(1)).alias("rows")], []
        left, right = [], []
        for i, n in enumerate(names):
            parts = [F.lit(n).alias("column"), (F.col("rows") - F.col(f"b{i}_n")).alias("missing")]
            first += describe_aggregates(dbl(n), f"b{i}_")
            parts += _described(f"b{i}_", "before")
            if self.has_truth:
                first += describe_aggregates(truth.get(n, dbl(n)), f"t{i}_")
                parts += _described(f"t{i}_", "truth")
            left.append(F.struct(*parts))
            if n in kept:
                second += describe_aggregates(dbl(n), f"a{i}_")
                error = F.lit(None).cast("double")
                if n in truth:
                    second.append(rmse_value(n).alias(f"e{i}"))
                    error = finite(F.col(f"e{i}"))
                right.append(F.struct(F.lit(n).alias("column"), *_described(f"a{i}_", "after"), error.alias("rmse")))
        before = self.before.agg(*first).select(F.inline(F.array(*left)))
        if not right:
            empty = ["after_n", "after_mean", "after_std", "after_min", "after_max", "rmse", "deviation_pct"]
            return before.withColumns({n: F.lit(None).cast("double") for n in empty})
        after = self.after.agg(*second).select(F.inline(F.array(*right)))
        reference = F.col("truth_mean" if self.has_truth else "before_mean")
        return (before.join(after, "column", "left")
                .withColumn("deviation_pct", relative_deviation(F.col("after_mean"), reference)))

    def histogram(self) -> DataFrame | None:
        series = {"before": (self.before, dbl(self.column))}
        if self.column in self.after.columns:
            series["after"] = (self.after, dbl(self.column))
        if self.has_truth:
            series["truth"] = (self.before, self._truth().get(self.column, dbl(self.column)))
        return shared_histogram(series)

    def corr_before(self) -> DataFrame | None:
        return correlation_matrix(self.before, self.numeric_columns) if len(self.numeric_columns) > 1 else None

    def corr_after(self) -> DataFrame | None:
        return correlation_matrix(self.after, self._kept()) if len(self._kept()) > 1 else None

    def corr_truth(self) -> DataFrame | None:
        if not self.has_truth or len(self.numeric_columns) < 2:
            return None
        return correlation_matrix(self.before.withColumns(self._truth()), self.numeric_columns)

    def table_before(self, limit: int = SHOWN_ROWS) -> DataFrame:
        return head(self._plain(self.before), self.key, limit)

    def table_after(self, limit: int = SHOWN_ROWS) -> DataFrame:
        return head(self._plain(self.after), self.key, limit)

    def gaps_first(self, limit: int = SHOWN_ROWS) -> DataFrame:
        return gaps_first(self._plain(self.before), self.key, limit)

    def dropped(self, limit: int | None = SHOWN_ROWS) -> DataFrame:
        if limit is None and "dropped" in self.extras:
            return self.extras["dropped"].select(*[c(k) for k in self.key])
        return dropped_rows(self.before, self.after, self.key, limit)

    def cells(self, limit: int | None = SHOWN_ROWS) -> DataFrame:
        return imputed_cells(self.after, self.key, limit)

    def shape_before(self) -> tuple[int, int]:
        return shapes(self.before, self.key)

    def shape_after(self) -> tuple[int, int]:
        return shapes(self.after, self.key)

    def missing_cells(self) -> tuple[int, int]:
        counts = [profile(d, data_columns(d, self.key)).missing_cells for d in (self.before, self.after)]
        return counts[0], counts[1]

    @staticmethod
    def _plain(df: DataFrame) -> DataFrame:
        return df.select(*[c(n) for n in df.columns if not is_internal(n)])


def analyse(df: DataFrame, key: str | Sequence[str], method: str = "none", params: dict | None = None,
            missing: dict | None = None, seed: int = 0, column: str | None = None) -> Report:
    """Gaps in (if the data is complete and ``missing`` asks for it), one method, and a report on it."""
    key = as_key(key)
    digits = str(seed if seed not in (None, "") else 0)
    if not digits.removeprefix("-").isdigit():
        raise EngineError("bad_param", f"A seed is a whole number, not {seed!r}.")
    seed = int(digits)
    df = normalise_missing(df)
    notes: list[str] = []
    columns = data_columns(df, key)
    floats = can_hold_nan(df, columns)
    native = has_gaps(df, [n for n in columns if n not in floats]) or bool(profile(df, floats).missing_cells)
    applied, before = None, df
    if missing and not native:
        applied = resolve_missing(df, key, **missing)
        before = inject_missing(df, key, applied["target"], applied["mechanism"], applied["rate"], applied["driver"], seed,
                                known_complete=True)
    elif missing:
        notes.append("No values were removed, because the table has gaps of its own.")
    result: Result = impute(before, method, params, seed, key, track=True)
    numeric = numeric_columns(before, key)
    return Report(before, result.frame, key, focus_column(before, numeric, column, applied), applied is not None, native,
                  applied, numeric, notes + result.notes, result.extras)


def focus_column(before: DataFrame, numeric: Sequence[str], asked: str | None, applied: dict | None) -> str:
    """The column that details are shown for. A numeric one that was asked for wins, then the one values were removed
    from, then the first with gaps; without any of them it is the first numeric column."""
    for wanted in (asked, (applied or {}).get("target")):
        if wanted in numeric:
            return wanted
    gaps = profile(before, numeric).with_gaps(numeric)
    return gaps[0] if gaps else numeric[0]
