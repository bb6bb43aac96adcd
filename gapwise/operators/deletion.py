"""Row and column deletion, and pairwise statistics that leave the data alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gapwise.errors import EngineError
from gapwise.functions.correlation import pair_table, square
from gapwise.functions.missing import all_present, any_missing, data_columns, numeric_columns, profile


def listwise(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Rows without a gap in any data column, text columns included."""
    return df.where(all_present(data_columns(df, key)))


def listwise_dropped(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The complement of ``listwise``; a filter, so no join is needed to know what went."""
    return df.where(any_missing(data_columns(df, key)))


def drop_sparse_columns(df: DataFrame, key: Sequence[str] = (), max_missing_pct: int = 30) -> DataFrame:
    """Keep the data columns whose share of gaps is at most the threshold (in percent)."""
    columns = data_columns(df, key)
    seen = profile(df, columns)
    keep = [n for n in columns if 100.0 * (seen.columns[n].missing / seen.rows if seen.rows else 0.0)
            <= max_missing_pct]
    if not keep:
        raise EngineError("no_columns_left", "No column is left at this threshold.")
    return df.drop(*[n for n in columns if n not in keep])


def pairwise_matrices(df: DataFrame, key: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Correlations over all available pairs, over complete rows, and the number of pairs used.

    One pass over the rows gives the sums of all three; what is kept of it is one row per pair of columns.
    """
    sums = pair_table(df, numeric_columns(df, key), listwise=True)
    half = df.sparkSession.createDataFrame(sums.collect(), sums.schema)
    pairwise = square(half)
    return {
        "corr_pairwise": pairwise.select("col_a", "col_b", "value"),
        "corr_listwise": square(half, prefix="list_").select("col_a", "col_b", "value"),
        "n_pairwise": pairwise.select("col_a", "col_b", "n"),
    }
