"""Crowded cells of the neighbour search, cut again until a unit of work is small.

The first tree is known to everybody, so its size is bounded and a cell of a long table may hold far more donors
than one task should. Such a cell gets a tree of its own, from its own sample. Trees and box tables are rows of
DataFrames here: they meet the donors and visitors of their cell in co-grouped pieces and never come to the driver.
A donor lies in one unit at every level and a visitor goes on only to units that can hold one of its nearest
donors, so copies grow in proportion to the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.operators.cells import Boxes, Splits, cut_sample, nearby, reachable
from gapwise.session import StagedTable, tasks_for, write_stage

UNIT = ["cell", "sub"]     # a cell of the first tree, and the path of cuts inside it
UNIT_SAMPLE = 8192         # rows (about) that place the cuts of one crowded unit
UNIT_DEPTH = 6             # a unit is cut into at most 2**UNIT_DEPTH units at a time
ROOM = 1.25                # units are aimed this much below the limit, since a sample's cuts are not quite even
BOX_DEPTH = 3              # each of them is described by 2**BOX_DEPTH boxes
SMALL_TABLE = 50_000       # rows of a table of units up to which it is broadcast
HASH_RANGE = 2**30


def join_units(df: DataFrame, units: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """``df`` with the columns of a table of units; the table is broadcast only while it is small."""
    return df.join(F.broadcast(units) if count <= SMALL_TABLE else units, UNIT, how)


def unit_counts(donors: DataFrame, visits: DataFrame) -> DataFrame:
    """(cell, sub, n, m): donors and visitors of every unit that has donors."""
    n = donors.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    m = visits.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, UNIT, "left").na.fill(0, ["m"])


def pieces(rows: str, task_rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(task_rows))).cast("int")


def _own(df: DataFrame) -> DataFrame:
    """The same rows in columns of their own, so that both sides of a co-group may come from one table."""
    return df.select(*[F.col(n).alias(n) for n in df.columns])


def _dealt(df: DataFrame, by: list[str], count: str) -> DataFrame:
    return df.withColumn("piece", F.pmod(F.xxhash64(*by), F.col(count)).cast("int"))


def _copied(df: DataFrame, count: str) -> DataFrame:
    return df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))


def refine(donors: DataFrame, visits: DataFrame, x: list[str], keys: list[str], k: int, width: int, task_rows: int,
           held: list[StagedTable]) -> tuple[DataFrame, DataFrame]:
    """Donors and visits with ``sub`` carried on until no unit has more than ``task_rows`` donors.

    ``donors`` has cell, sub, mixed, x, v and keys; ``visits`` has cell, sub, row, bound and x. A unit that no cut
    can divide (its rows differ only where others have gaps) stays as it is, for the caller to deal into shares.
    """
    before = None
    while True:
        held.append(write_stage(unit_counts(donors, visits).where(F.col("n") > task_rows), "crowded"))
        units = held[-1].frame
        count, rows = units.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not count or (count, rows) == before:
            return donors, visits
        before = count, rows
        units = units.withColumns({"dn": pieces("n", task_rows), "rn": pieces("m", task_rows)})
        donors, visits = _cut(donors, visits, units, count, rows, x, keys, k, width, task_rows, held)


def _cut(donors: DataFrame, visits: DataFrame, units: DataFrame, count: int, rows: int, x: list[str], keys: list[str],
         k: int, width: int, task_rows: int, held: list[StagedTable]) -> tuple[DataFrame, DataFrame]:
    donor_names, visit_names = donors.columns, visits.columns

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        first = sample.iloc[0]
        cells = min(UNIT_DEPTH, max(1, math.ceil(math.log2(ROOM * first["n"] / task_rows))))
        tree = cut_sample(sample[x].to_numpy(dtype=float), cells + BOX_DEPTH)
        return pd.DataFrame({"cell": [first["cell"]], "sub": [first["sub"]], "axis": [tree.axis.tolist()],
                             "cut": [tree.cut.tolist()], "depth": [tree.depth]})

    def place(local: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        leaf = np.zeros(len(local), dtype=np.int64)
        if len(local) and len(tree):
            at = tree.iloc[0]
            leaf = Splits(np.array(at["axis"]), np.array(at["cut"]), int(at["depth"])).leaf(local[x].to_numpy(dtype=float))
        return local[donor_names].assign(leaf=leaf, into=[f"{sub}/{n >> BOX_DEPTH}" for sub, n in zip(local["sub"], leaf)])

    def visit(visitors: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(table):
            return visitors.iloc[:0][visit_names]
        grid = lambda prefix: table[[f"{prefix}_{n}" for n in x]].to_numpy(dtype=float)
        size = table["n"].to_numpy()
        boxes = Boxes(grid("lo"), grid("hi"), grid("n") == size[:, None], ~table["mixed"].to_numpy(dtype=bool), size)
        q, limit = visitors[x].to_numpy(dtype=float), visitors["bound"].to_numpy(dtype=float)
        at, box, bound = reachable(q, boxes, k, width, [nearby(q)], limit)
        names, of_box = np.unique(table["into"].to_numpy(dtype=str), return_inverse=True)
        pairs = np.unique(np.column_stack([at, of_box[box]]), axis=0)
        return visitors.iloc[pairs[:, 0]][visit_names].assign(sub=names[pairs[:, 1]], bound=np.minimum(bound, limit)[pairs[:, 0]])

    spark = donors.sparkSession
    piece = [*UNIT, "piece"]
    tasks = tasks_for(spark, rows, task_rows)
    inside = join_units(donors, units, count)
    few = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(HASH_RANGE)) * F.col("n") < F.lit(HASH_RANGE * UNIT_SAMPLE)
    unit_fields = [f for f in donors.schema.fields if f.name in UNIT]
    trees = (inside.where(few).select(*UNIT, "n", *x).groupBy(*UNIT)
             .applyInPandas(grow, T.StructType([*unit_fields, *T.StructType.fromDDL("axis array<long>, cut array<double>, depth int").fields])))
    held.append(write_stage(trees, "trees"))
    trees = held[-1].frame
    cut = (_dealt(inside, keys, "dn").repartition(tasks, *piece).groupBy(*piece)
           .cogroup(_own(_copied(join_units(units.select(*UNIT, "dn"), trees, count), "dn")).repartition(tasks, *piece).groupBy(*piece))
           .applyInPandas(place, T.StructType([*donors.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("into", T.StringType())])))
    held.append(write_stage(cut, "cut-donors"))
    cut = held[-1].frame
    sums = [F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed"), F.first("into").alias("into")]
    for n in x:
        sums += [F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"), F.count(n).alias(f"n_{n}")]
    tables = cut.groupBy(*UNIT, "leaf").agg(*sums)
    sent = (_dealt(join_units(visits, units.select(*UNIT, "rn"), count), ["row"], "rn").repartition(tasks, *piece).groupBy(*piece)
            .cogroup(_own(_copied(join_units(tables, units.select(*UNIT, "rn"), count), "rn")).repartition(tasks, *piece).groupBy(*piece))
            .applyInPandas(visit, visits.schema))
    held.append(write_stage(sent, "cut-visits"))
    sent = held[-1].frame
    moved = cut.withColumn("sub", F.col("into")).select(*donors.columns)
    return (join_units(donors, units.select(*UNIT), count, "left_anti").unionByName(moved),
            join_units(visits, units.select(*UNIT), count, "left_anti").unionByName(sent))
