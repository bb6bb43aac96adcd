"""Fitted fills on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gapwise.functions.missing import normalise_missing


def fill_stream(stream: DataFrame, model) -> DataFrame:
    """Fill a streaming frame with a model fitted on a table.

    A fitted model is only column expressions (or one Arrow UDF), so it needs no state and no watermark.
    """
    return model.transform(normalise_missing(stream))
