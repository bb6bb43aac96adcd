"""Helpers shared by the operators: reading tables, Arrow batches, text as words."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a task; bounds a task's memory whatever the batch size of the session.
SLICE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text: bytes.split() cuts at exactly these six characters."""
    return text.split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


_HELD: dict[str, object] = {}
_ASKED: set[str] = set()


def held(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once in this worker process and held until a task of map_slices does not ask for ``name``."""
    _ASKED.add(name)
    if name not in _HELD:
        _HELD[name] = build()
    return _HELD[name]


def let_go() -> None:
    """Drop what is held but not asked for since the task began. Spark keeps idle workers, and their memory counts in every later stage."""
    unused = [name for name in _HELD if name not in _ASKED]
    for name in unused:
        del _HELD[name]
    if unused:
        gc.collect()


def new_task() -> None:
    _ASKED.clear()


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Run ``work`` on slices of Arrow batches; it returns columns (lists or arrays) by name.

    ``work`` gets one record batch of at most SLICE_ROWS rows and its output may have any number of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = work(batch.slice(start, SLICE_ROWS))
                let_go()
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=target.field(k).type) for k, v in columns.items()],
                    names=list(columns))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def crc_mod(column: str, mod: int):
    """crc32 of a column's text form, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


def add_columns(df: DataFrame, keep: list[str], text: str, work: Callable[[list], dict], shape: str, binary: bool = True) -> DataFrame:
    """``keep`` columns of ``df`` and the columns that ``work`` makes from a list of texts, in one pass without shuffle.

    The text travels under a name of its own, so clashing names do no harm; kept columns pass unchanged.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    names = [f"__keep{i}" for i in range(len(fields))]
    kept = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, fields))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("__text")
        return {n: batch.column(n) for n in names} | work(as_bytes(texts) if binary else as_text(texts))

    source = df.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, fields)], F.col(f"`{text}`").alias("__text"))
    out = map_slices(source, run, f"{kept}{shape}")
    return out.withColumnsRenamed({n: f.name for n, f in zip(names, fields)})


SHARES = 1 << 24


def hash_share(rank, rows: int, total: int):
    """True for about ``rows`` of ``total`` different values of the hash column ``rank``; for all where there are fewer."""
    return F.pmod(F.shiftrightunsigned(rank, 7), F.lit(SHARES)) < int(min(1.0, rows / max(1, total)) * SHARES)


def bounded_sample(df: DataFrame, rows: int, text: str = "text") -> list[str]:
    """At most ``rows`` different texts, chosen by a hash of the text: the same ones for any layout.

    Tasks send only texts whose hash falls into the share that holds about ``rows`` texts, each once, so
    what reaches the driver does not grow with the table or with the number of tasks.
    """
    return distinct_texts(df.where(hash_share(F.xxhash64(text), rows, df.count())), rows, text)


def distinct_texts(df: DataFrame, rows: int, text: str = "text") -> list[str]:
    """The different texts of a small table, at most ``rows``, in an order of their own; nulls are left out."""
    known = df.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("rank")).agg(F.min(text).alias("text"))
    return [r["text"] for r in known.orderBy("rank").limit(rows).collect()]
