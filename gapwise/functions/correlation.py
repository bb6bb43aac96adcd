"""Pairwise-complete correlations that survive constant columns and ANSI mode."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import all_present, c, dbl, profile

# Above this many columns the pair sums are built from per-partition matrices instead of one wide aggregate.
WIDE = 6

PAIR_SCHEMA = "col_a string, col_b string, n long, sd_a double, sd_b double, cov double"


def _limit_unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def safe_corr(n: Column, sd_a: Column, sd_b: Column, cov: Column, min_periods: int = 2) -> Column:
    defined = (n >= F.lit(max(2, min_periods))) & (sd_a > 0) & (sd_b > 0)
    return F.when(defined, _limit_unit(cov / (sd_a * sd_b)))


def pair_aggregates(a: str, b: str) -> tuple[Column, Column, Column, Column]:
    """(n, sd_a, sd_b, cov) of one pair, all over the rows where both are present."""
    x, y = dbl(a), dbl(b)
    both = c(a).isNotNull() & c(b).isNotNull()
    return (F.count_if(both), F.stddev_samp(F.when(both, x)), F.stddev_samp(F.when(both, y)),
            F.covar_samp(x, y))


#: Sums of one pair, and with ``listwise`` the same over the rows without a gap in any column.
SUMS = ("n", "sd_a", "sd_b", "cov")


def _narrow_pairs(df: DataFrame, cols: Sequence[str], listwise: bool) -> DataFrame:
    aggs, items = [], []
    whole = all_present(cols)
    for k, (a, b) in enumerate((a, b) for i, a in enumerate(cols) for b in cols[i:]):
        sums = dict(zip(SUMS, pair_aggregates(a, b)))
        if listwise:
            x, y = (F.when(whole, dbl(n)) for n in (a, b))
            sums |= dict(zip((f"list_{s}" for s in SUMS), (F.count_if(whole), F.stddev_samp(x), F.stddev_samp(y), F.covar_samp(x, y))))
        aggs += [v.alias(f"{name}{k}") for name, v in sums.items()]
        items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), *[F.col(f"{name}{k}").alias(name) for name in sums]))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def _wide_pairs(df: DataFrame, cols: Sequence[str], listwise: bool) -> DataFrame:
    """Per-partition cross-product matrices, summed by Spark: p*(p+1)/2 rows leave each partition."""
    seen = profile(df, cols, cols)
    shift = np.array([seen.columns[n].mean or 0.0 for n in cols])
    upper = np.triu_indices(len(cols))
    width = 12 if listwise else 6

    def products(x: np.ndarray) -> np.ndarray:
        o = ~np.isnan(x)
        z, w = np.where(o, x, 0.0), o.astype(float)
        return np.stack([w.T @ w, z.T @ w, w.T @ z, (z * z).T @ w, w.T @ (z * z), z.T @ z])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            part = products(x)
            if listwise:
                part = np.concatenate([part, products(x[~np.isnan(x).any(axis=1)])])
            total = part if total is None else total + part
        if total is not None:
            flat = total[:, upper[0], upper[1]]
            yield pd.DataFrame({"i": upper[0], "j": upper[1], **{f"t{k}": flat[k] for k in range(width)}})

    numbers = df.select(*[dbl(n).alias(f"x{i}") for i, n in enumerate(cols)])
    schema = "i int, j int, " + ", ".join(f"t{k} double" for k in range(width))
    t = numbers.mapInPandas(sums, schema).groupBy("i", "j").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(width)])
    names = F.array(*[F.lit(n) for n in cols])
    var = lambda sq, s, n: F.greatest(F.lit(0.0), F.try_divide(sq - F.try_divide(s * s, n), n - 1))

    def made(at: int, prefix: str) -> list[Column]:
        n, sa, sb, qa, qb, ab = (F.col(f"t{at + k}") for k in range(6))
        cov = F.try_divide(ab - F.try_divide(sa * sb, n), n - 1)
        return [v.alias(prefix + name) for name, v in zip(SUMS, (n.cast("long"), F.sqrt(var(qa, sa, n)), F.sqrt(var(qb, sb, n)), cov))]

    return t.select(names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), *made(0, ""), *(made(6, "list_") if listwise else []))


def pair_table(df: DataFrame, cols: Sequence[str], listwise: bool = False) -> DataFrame:
    """Upper triangle (with diagonal) of pairwise-complete sums; with ``listwise`` those of the complete rows come from the same pass."""
    return (_narrow_pairs if len(cols) <= WIDE else _wide_pairs)(df, cols, listwise)


def square(half: DataFrame, min_periods: int = 2, prefix: str = "") -> DataFrame:
    """Long matrix (col_a, col_b, n, value) with both triangles from the sums of the upper one; undefined entries are NULL."""
    n = F.col(f"{prefix}n")
    value = safe_corr(n, *[F.col(prefix + s) for s in SUMS[1:]], min_periods)
    value = F.when(F.col("col_a") == F.col("col_b"), F.when(value.isNotNull(), F.lit(1.0))).otherwise(value)
    both = F.array(F.struct(F.col("col_a").alias("a"), F.col("col_b").alias("b")),
                   F.struct(F.col("col_b").alias("a"), F.col("col_a").alias("b")))
    one = F.array(F.struct(F.col("col_a").alias("a"), F.col("col_b").alias("b")))
    side = F.when(F.col("col_a") == F.col("col_b"), one).otherwise(both)
    return (half.select(F.explode(side).alias("p"), n.alias("n"), value.alias("value"))
            .select(F.col("p.a").alias("col_a"), F.col("p.b").alias("col_b"), "n", "value"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], min_periods: int = 2) -> DataFrame:
    """Long matrix (col_a, col_b, n, value) of the pairwise-complete correlations."""
    return square(pair_table(df, cols), min_periods)


def correlation_with(df: DataFrame, target: str, others: Sequence[str]) -> dict[str, float]:
    """|corr| of every other column with ``target``; undefined counts as 0. One aggregate job."""
    if not others:
        return {}
    out = []
    for k, other in enumerate(others):
        n, sa, sb, cov = pair_aggregates(other, target)
        out.append(F.coalesce(F.abs(safe_corr(n, sa, sb, cov)), F.lit(0.0)).alias(f"r{k}"))
    row = df.agg(*out).first()
    return {other: row[f"r{k}"] for k, other in enumerate(others)}
