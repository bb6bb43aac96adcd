"""Working on the rows with gaps only, while complete rows never move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.missing import all_present, any_missing, c, dbl
from gapwise.session import stage

ROW = "__row"


def fill_name(i: int) -> str:
    return f"__fill_{i}"


def split_rows(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete). The incomplete rows are written once, so their ``__row`` ids are final.

    They are rebalanced first: gaps may crowd in a few files, and every later pass runs over this copy.
    """
    numbered = df.where(any_missing(cols)).hint("rebalance").withColumn(ROW, F.monotonically_increasing_id())
    return df.where(all_present(cols)), stage(numbered, "incomplete")


def join_fills(complete: DataFrame, incomplete: DataFrame, fills: DataFrame, columns: Sequence[str],
               fallback: dict[str, float], carry: Sequence[str] = ()) -> DataFrame:
    """Put ``__fill_i`` into the gaps of ``columns[i]``; only incomplete rows are shuffled."""
    joined = incomplete.join(fills, ROW, "left")
    out = {n: F.coalesce(dbl(n), c(fill_name(i)), F.lit(fallback[n])) for i, n in enumerate(columns)}
    order = complete.columns
    filled = joined.withColumns(out).select(*[c(n) for n in order], *[c(n) for n in carry])
    whole = complete.withColumns({n: dbl(n) for n in columns})
    return whole.unionByName(filled, allowMissingColumns=bool(carry))
