"""Reading tables: Parquet and friends as they are, delimited text with missing-value tokens."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.errors import EngineError
from gapwise.functions.missing import c, normalise_missing, numeric_columns

# Texts read as "missing".
MISSING_TOKENS = [
    "", "NA", "N/A", "NaN", "nan", "null", "NULL", "?",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "None", "n/a",
]
DELIMITERS = ",;\t|"
#: What counts as a number: no type suffix, so codes such as 12d or 3f stay text.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(Infinity|inf|Inf)\s*$"
BROKEN = "__broken_row"


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A row key for data without one: unique, increasing in file order, and final because it is written once."""
    from gapwise.session import stage

    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def _refuse(wrong: bool, code: str, message: str) -> None:
    if wrong:
        raise EngineError(code, message)


def validate_frame(df: DataFrame, key: Sequence[str] = (), max_rows: int | None = None,
                   max_columns: int | None = None) -> DataFrame:
    """The rules for tables: distinct names, some rows, a numeric column, and limits only where the caller sets them."""
    _check_names(df.columns)
    width = len(df.columns)
    _refuse(max_columns is not None and width > max_columns, "too_many_columns", f"{width} columns, {max_columns} at most.")
    _refuse(not width or df.isEmpty(), "empty_table", "No row to work on.")
    _refuse(max_rows is not None and df.limit(max_rows + 1).count() > max_rows, "too_many_rows", f"Over {max_rows} rows.")
    clean = normalise_missing(df)
    _refuse(not numeric_columns(clean, key), "no_numeric_column", "No column holds numbers.")
    return clean


def _check_names(names: Sequence[str]) -> None:
    _refuse(any(not n.strip() or n.startswith("Unnamed:") for n in names), "missing_header", "Every column needs a name in the first line.")
    _refuse(len({*names}) < len(names), "duplicate_columns", "Two columns have one name.")


def _sniff(line: str) -> str:
    counts = {d: len(next(csv.reader([line], delimiter=d), [])) for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: counts[d])


def _typed(df: DataFrame) -> DataFrame:
    """Type every text column from one aggregate: long, double, boolean or text; all-missing means double."""
    kinds = ("bigint", "double", "boolean")
    aggs = []
    for i, n in enumerate(df.columns):
        aggs.append(F.count(c(n)).alias(f"n{i}"))
        aggs += [F.count(F.when(c(n).rlike(NUMBER), c(n).try_cast(k)) if k == "double" else c(n).try_cast(k)).alias(f"{k}{i}")
                 for k in kinds]
        aggs.append(F.count_if(F.lower(c(n)).isin("true", "false")).alias(f"word{i}"))
        aggs.append(F.count_if(c(n).rlike(r"^[+-]?\d+$")).alias(f"digits{i}"))
    row = df.agg(*aggs).first()
    out = {}
    for i, n in enumerate(df.columns):
        seen = row[f"n{i}"]
        if seen == 0:
            out[n] = F.lit(None).cast("double")
        elif row[f"bigint{i}"] == seen and row[f"digits{i}"] == seen:
            out[n] = c(n).cast("bigint")
        elif row[f"double{i}"] == seen:
            out[n] = c(n).cast("double")
        elif row[f"word{i}"] == seen:
            out[n] = c(n).cast("boolean")
    return normalise_missing(df.withColumns(out) if out else df)


def _header(spark: SparkSession, path: str | list[str]) -> str:
    """The first line, the same in all files of the path."""
    lines = spark.read.text(path)
    if len(lines.inputFiles()) > 1:
        placed = lines.where(F.trim("value") != "").select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        firsts = placed.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("line")).select("line").distinct().limit(2).collect()
        _refuse(len(firsts) > 1, "parse_error", "The files of this path have different header lines.")
        found = firsts[0]["line"] if firsts else None
    else:
        found = next((r["value"] for r in lines.where(F.trim("value") != "").limit(1).collect()), None)
    _refuse(found is None, "empty_file", "There is nothing in the file.")
    return found.lstrip("\ufeff")


def _open_lines(lines: DataFrame, sep: str) -> DataFrame:
    """The lines that end inside a quoted cell. A quote counts where it opens a cell or stands in one that it opened, so
    5" pipe is text; lines without a quote are not looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            found = []
            for line in batch.column("value").to_pylist():
                try:
                    next(csv.reader([line.replace(sep, "\x1f")], delimiter="\x1f", skipinitialspace=True, strict=True), None)
                except csv.Error as exc:
                    if "end of data" in str(exc):
                        found.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    return lines.where(F.contains("value", F.lit('"'))).mapInArrow(run, "value string")


def read_csv_table(spark: SparkSession, path: str | list[str], sep: str | None = None, max_rows: int | None = None,
                   max_columns: int | None = None, multiline: bool = False) -> DataFrame:
    """Delimited text with a header line, quoted as spreadsheets do it (a quote inside quotes is doubled).

    The separator is found from the header line if not given. Line breaks inside quotes need ``multiline``, since
    files are then not split. A row that does not have the header's number of cells, or ends inside quotes, is a
    ``parse_error``: nothing is cut or filled up. Blanks around a token do not matter ("NA " is missing).
    """
    first, broken = _header(spark, path), BROKEN
    sep = sep or _sniff(first)
    header = [h.strip() for h in next(csv.reader([first], delimiter=sep, skipinitialspace=True))]
    _check_names(header)
    while broken in header:
        broken += "_"
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, broken]])
    text = (spark.read.schema(schema)
            .options(sep=sep, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, quote='"', escape='"',
                     multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=broken).csv(path))
    wrong = c(broken).isNotNull()
    if not multiline:  # a quoted cell that goes on in the next line
        _refuse(not _open_lines(spark.read.text(path), sep).isEmpty(), "parse_error", "A quoted cell does not end in its line; multiline reads such files.")
    bad = text.where(wrong).limit(1).collect()
    _refuse(bool(bad), "parse_error", f"A row does not fit the {len(header)} columns of the header: {bad[0][broken][:200]!r}" if bad else "")
    cleaned = text.select(*[F.when(~F.trim(c(n)).isin(MISSING_TOKENS), c(n)).alias(n) for n in header])
    _refuse(cleaned.isEmpty(), "empty_table", "There is only a header line.")
    return validate_frame(_typed(cleaned), max_rows=max_rows, max_columns=max_columns)


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """Any format Spark reads; delimited text goes through the token-aware reader."""
    if fmt in ("csv", "tsv"):
        return read_csv_table(spark, path, **options)
    return validate_frame(spark.read.format(fmt).options(**options).load(path))


def load_dataset(spark: SparkSession, spec: dict) -> DataFrame:
    """``{"kind": "csv" | "parquet" | "orc" | "json" | "table", "path" or "name": ...}``"""
    kind = spec.get("kind")
    if kind == "table":
        name = spec.get("name")
        if not name or not spark.catalog.tableExists(name):
            raise EngineError("unknown_dataset", f"Unknown table: {name}")
        return validate_frame(spark.table(name))
    if kind in ("csv", "tsv", "parquet", "orc", "json"):
        return read_table(spark, spec.get("path", ""), kind)
    raise EngineError("unknown_dataset", f"Unknown kind of data set: {kind}")
