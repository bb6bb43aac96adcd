"""Exact nearest-neighbour imputation as Spark joins over spatial cells.

Donors are cut into cells whose boxes are known to everybody (a bounded table). A row with a gap
first meets the donors of the cell it lies in; the k-th of them is a bound, and the row is sent on only to the cells
that can hold a donor within it. Cells meet their visitors in a co-grouped task, and the few winners per cell are
merged. Nothing is sampled, capped or approximated: the sample below only places the cuts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions.missing import Profile, all_present, any_missing, c, dbl
from gapwise.operators.cells import DECIMALS, Boxes, Splits, cut_sample, merged, nearest, reachable, reachable_within
from gapwise.operators.incomplete import ROW, fill_name, join_fills
from gapwise.operators.refine import UNIT, join_units, pieces, refine, unit_counts
from gapwise.session import StagedTable, stage, tasks_for, write_stage

BOX_ROWS = 64          # donors aimed at per box; boxes give the distance bounds
MAX_BOXES = 8192       # so a box holds more donors in a long table; twice this plus one per pattern at most
CELL_ROWS = 16_384     # donors aimed at per cell, the unit of work: a run of neighbouring boxes
MAX_CELLS = 4096
MAX_PATTERNS = 64      # donor patterns with boxes of their own; the rest share mixed boxes
CUT_SAMPLE = 50_000    # rows used to place the cuts
DRIVER_CELLS = 4_000_000  # numbers in the sample, or box corners, that may come to the driver
SEARCH_ROWS = 25_000   # receivers per task while cells are looked up
TASK_ROWS = 200_000    # donors, and visitors, that meet in one unit of work at most (about)


def standardised(name: str, seen: Profile, scale: bool = True) -> Column:
    """Centred, and divided by the population spread; a constant column keeps spread 1."""
    at = seen.columns[name]
    x = dbl(name) - F.lit(at.mean)
    return x / F.lit(at.std_pop if at.std_pop else 1.0) if scale else x


def _x(p: int) -> list[str]:
    return [f"x{i}" for i in range(p)]


def _pattern(p: int) -> Column:
    return F.concat(F.lit(""), *[F.when(F.col(n).isNull(), "1").otherwise("0") for n in _x(p)])


def distinct_donors(donors: DataFrame, p: int, keys: Sequence[str], k: int) -> DataFrame:
    """Of identical donors only the k smallest keys can ever be chosen.

    Spark prunes each map task to k rows per group before the shuffle, so a vector shared by a third
    of the table does not become a hot partition.
    """
    same = Window.partitionBy(*_x(p)).orderBy(*keys)
    return donors.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k).drop("rn")


def _depth(rows: float, unit: float, least: int = 0) -> int:
    return max(least, math.ceil(math.log2(max(1.0, rows / unit))))


def _leaf(splits: Splits, p: int):
    def leaf(*cols: pd.Series) -> pd.Series:
        return pd.Series(splits.leaf(np.column_stack([s.to_numpy(dtype=float) for s in cols])))

    return F.pandas_udf(leaf, T.LongType())(*[F.col(n) for n in _x(p)])


def _boxes(donors: DataFrame, p: int) -> tuple[Boxes, np.ndarray]:
    """Summary of every box; its size is bounded by MAX_BOXES, whatever the number of donors."""
    aggs = [F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed"), F.max("cell").alias("cell")]
    for n in _x(p):
        aggs += [F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"), F.count(n).alias(f"n_{n}")]
    table = donors.groupBy("box").agg(*aggs).orderBy("box").toPandas()
    grid = lambda prefix: table[[f"{prefix}_{n}" for n in _x(p)]].to_numpy(dtype=float)
    count = table["n"].to_numpy()
    boxes = Boxes(grid("lo"), grid("hi"), grid("n") == count[:, None], ~table["mixed"].to_numpy(dtype=bool), count)
    return boxes, table["cell"].to_numpy()


@dataclass(frozen=True)
class _Layout:
    """How deep the shared tree is read: per pattern class, for boxes and for cells."""
    splits: Splits
    classes: list[tuple[str, int, int]]
    rest: tuple[int, int]

    @staticmethod
    def of(sample: np.ndarray, patterns: list[tuple[str, int]], total: int) -> _Layout:
        most = min(MAX_BOXES, DRIVER_CELLS // (3 * sample.shape[1]))
        box_unit, cell_unit = max(BOX_ROWS, total / most), max(CELL_ROWS, total / MAX_CELLS)

        def depths(rows: int, least: int) -> tuple[int, int]:
            box = _depth(rows, box_unit, least)
            return box, min(box, _depth(rows, cell_unit, least))

        classes = [(text, *depths(rows, 3 if i == 0 else 0)) for i, (text, rows) in enumerate(patterns)]
        rest = depths(max(0, total - sum(rows for _, rows in patterns)), 0)
        return _Layout(cut_sample(sample, max([box for _, box, _ in classes] + [rest[0]])), classes, rest)

    def _by_class(self, p: int, values: list[int], other: int) -> Column:
        out = F.lit(other)
        for (text, _, _), value in zip(self.classes, values):
            out = F.when(_pattern(p) == F.lit(text), F.lit(value)).otherwise(out)
        return out

    def _numbered(self, df: DataFrame, p: int, kind: Column, cut: dict[str, Column]) -> DataFrame:
        return (df.withColumns({"leaf": _leaf(self.splits, p), "kind": kind})
                .withColumns({n: F.col("kind") * F.lit(2**40) + F.floor(F.col("leaf") / F.pow(F.lit(2.0), by)).cast("long")
                              for n, by in cut.items()}))

    def place(self, donors: DataFrame, p: int) -> DataFrame:
        """Adds box and cell numbers: class and leaf, with the leaf read to the depth of the class."""
        deep = self.splits.depth
        kind = self._by_class(p, list(range(len(self.classes))), MAX_PATTERNS)
        cut = {"box": self._by_class(p, [deep - b for _, b, _ in self.classes], deep - self.rest[0]),
               "cell": self._by_class(p, [deep - b for _, _, b in self.classes], deep - self.rest[1])}
        return self._numbered(donors, p, kind, cut).withColumn("mixed", F.col("kind") == F.lit(MAX_PATTERNS)).drop("leaf", "kind")

    def settle(self, receivers: DataFrame, p: int) -> DataFrame:
        """Adds the number of the cell where donors of the receiver's own pattern lie, or else of the commonest."""
        deep = self.splits.depth
        kind = self._by_class(p, list(range(len(self.classes))), 0)
        cut = {"cell": self._by_class(p, [deep - b for _, _, b in self.classes], deep - self.classes[0][2])}
        return self._numbered(receivers, p, kind, cut).drop("leaf", "kind")


def _common_patterns(donors: DataFrame, sample: np.ndarray, p: int, whole: bool) -> list[tuple[str, int]]:
    """The commonest donor patterns with their row counts; read off the sample if it holds every donor."""
    if whole:
        masks, counts = np.unique(np.isnan(sample), axis=0, return_counts=True)
        found = [("".join("1" if m else "0" for m in mask), int(n)) for mask, n in zip(masks, counts)]
        return sorted(found, key=lambda f: (-f[1], f[0]))[:MAX_PATTERNS]
    rows = (donors.groupBy(_pattern(p).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "pattern").limit(MAX_PATTERNS).collect())
    return [(r["pattern"], r["n"]) for r in rows]


@dataclass(frozen=True)
class _Shares:
    """How many tasks' worth of work there is, and the units whose donors (dn) or visitors (rn) are dealt into shares."""
    units: int
    split: DataFrame | None = None
    count: int = 0

    def join(self, df: DataFrame) -> DataFrame:
        if not self.count:
            return df.withColumns({"dn": F.lit(1), "rn": F.lit(1)})
        return join_units(df, self.split, self.count, "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("dn", "rn")})


def _shares(placed: DataFrame, visits: DataFrame, cells: int, crowded: bool, receiver_count: int, task_rows: int,
            held: list[StagedTable]) -> _Shares:
    if receiver_count <= task_rows and not crowded:
        return _Shares(cells)  # no cell can be visited more often than there are receivers
    if crowded:
        counts = unit_counts(placed, visits)
    else:  # every cell's donors fit one task
        counts = visits.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.lit(1))
    plan = counts.select(*UNIT, pieces("n", task_rows).alias("dn"), pieces("m", task_rows).alias("rn"))
    held.append(write_stage(plan, "shares"))
    split = held[-1].frame.where("dn > 1 or rn > 1")
    units = held[-1].frame.agg(F.sum(F.col("dn").cast("long") * F.col("rn"))).first()[0]
    return _Shares(int(units or 1), split, split.count())


def _meet(placed: DataFrame, visits: DataFrame, shares: _Shares, x: list[str], keys: Sequence[str]):
    """Co-groups of a cell's visitors with its donors, each with the columns of the search."""
    units = max(1, shares.units)
    tasks = min(2 * units, max(4 * visits.sparkSession.sparkContext.defaultParallelism, units // 8))
    meet = [*UNIT, "dpart", "rpart"]
    left = (shares.join(visits).withColumn("rpart", F.pmod(F.xxhash64("row"), F.col("rn")).cast("int"))
            .withColumn("dpart", F.explode(F.sequence(F.lit(0), F.col("dn") - 1)))
            .select(*meet, "row", "bound", *x).repartition(tasks, *meet))
    right = (shares.join(placed).withColumn("dpart", F.pmod(F.xxhash64(*keys), F.col("dn")).cast("int"))
             .withColumn("rpart", F.explode(F.sequence(F.lit(0), F.col("rn") - 1)))
             .select(*[F.col(n).alias(n) for n in (*meet, *x, "v", *keys)]).repartition(tasks, *meet))
    return left.groupBy(*meet).cogroup(right.groupBy(*meet))


def nearest_donors(receivers: DataFrame, receiver_count: int, donors: DataFrame, p: int, keys: Sequence[str], k: int,
                   width: int, held: list[StagedTable], task_rows: int | None = None) -> DataFrame:
    """(row, v, d2): for every receiver its k nearest donors by (rounded distance, key).

    ``receivers`` has ``row`` and x0..; ``donors`` has x0.., ``v`` and the key columns. ``width`` is
    the p of the distance formula (all columns, the target included). Written copies that the result
    reads are added to ``held``; the caller drops them once it has used the result.
    """
    spark, task_rows = receivers.sparkSession, task_rows or TASK_ROWS
    parallel = tasks_for(spark, receiver_count, SEARCH_ROWS)
    x = _x(p)
    nobody = receivers.select("row", F.lit(0.0).alias("v"), F.lit(0.0).alias("d2")).limit(0)
    distinct = write_stage(distinct_donors(donors, p, keys, k), "donors")
    held.append(distinct)
    donors = distinct.frame
    total, sample_rows = donors.count(), min(CUT_SAMPLE, DRIVER_CELLS // p)
    picked = donors if total <= sample_rows else donors.sample(0.9 * sample_rows / total, seed=0)
    sample = picked.select(*x).limit(sample_rows).toPandas().to_numpy(dtype=float)
    if not len(sample):
        return nobody
    patterns = _common_patterns(donors, sample, p, total <= sample_rows)
    layout = _Layout.of(sample, patterns, total)
    held.append(write_stage(layout.place(donors, p), "placed"))
    placed = held[-1].frame
    distinct.drop()
    boxes, cell_of_box = _boxes(placed, p)
    cell_ids, of_box = np.unique(cell_of_box, return_inverse=True)
    cells = merged(boxes, of_box)
    crowded = bool((cells.count > task_rows).any())
    shift = layout.splits.depth - layout.classes[0][2]
    key_fields = [f for f in donors.schema.fields if f.name in keys]
    winner_fields = [T.StructField("row", T.LongType()), T.StructField("d2", T.DoubleType()),
                     T.StructField("v", T.DoubleType()), *key_fields]
    visit_fields = [T.StructField("cell", T.LongType()), T.StructField("bound", T.DoubleType())]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = pdf["leaf"].to_numpy()
            at, box, bound = reachable(pdf[x].to_numpy(dtype=float), boxes, k, width,
                                       [leaf >> shift, leaf >> (shift // 2), leaf])
            pairs = np.unique(np.column_stack([at, of_box[box]]), axis=0)
            out = pdf.iloc[pairs[:, 0]].drop(columns=["leaf"]).copy()
            out["cell"], out["bound"] = cell_ids[pairs[:, 1]], bound[pairs[:, 0]]
            yield out

    def look(visitors: pd.DataFrame, local: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        at, d2 = nearest(visitors[x].to_numpy(dtype=float), local[x].to_numpy(dtype=float), k, width,
                         visitors["bound"].to_numpy(dtype=float))
        r, rank = np.nonzero(at >= 0)
        chosen = local.iloc[at[r, rank]]
        out = pd.DataFrame({"row": visitors["row"].to_numpy()[r], "d2": d2[r, rank], "v": chosen["v"].to_numpy()})
        for name in keys:
            out[name] = chosen[name].to_numpy()
        return out, d2

    def match(visitors: pd.DataFrame, local: pd.DataFrame) -> pd.DataFrame:
        return look(visitors, local.sort_values(list(keys), kind="stable"))[0]

    def match_home(unit: tuple, visitors: pd.DataFrame, local: pd.DataFrame) -> pd.DataFrame:
        """The winners of the cell, and as rows of their own (with a cell number) the visits to other cells."""
        local = local.sort_values(list(keys), kind="stable")
        out, d2 = look(visitors, local)
        out = out.assign(cell=-1, bound=0.0, **dict.fromkeys(x, 0.0))
        if not len(visitors):
            return out
        at, cell, bound = reachable_within(visitors[x].to_numpy(dtype=float), d2[:, k - 1], cells, boxes, of_box, k, width)
        other = cell_ids[cell] != unit[0]
        at, cell = at[other], cell[other]
        go = visitors.iloc[at][["row", *x]].assign(d2=0.0, v=0.0, cell=cell_ids[cell], bound=bound[at])
        for name in keys:  # of any donor: whole numbers would not stay whole beside gaps
            go[name] = local[name].to_numpy()[np.zeros(len(at), dtype=np.int64)] if len(local) else None
        return pd.concat([out, go[out.columns]], ignore_index=True) if len(out) else go

    placed, first = placed.drop("box").withColumn("sub", F.lit("")), None
    if crowded:
        # neighbours in space share a batch; the row number splits a crowded leaf over several tasks
        located = (receivers.withColumn("leaf", _leaf(layout.splits, p))
                   .repartitionByRange(parallel, "leaf", "row").sortWithinPartitions("leaf"))
        visits = located.mapInPandas(find, T.StructType(receivers.schema.fields + visit_fields)).withColumn("sub", F.lit(""))
        held.append(write_stage(visits, "visits"))  # read several times, so the cells are looked up once
        placed, visits = refine(placed, held[-1].frame, x, list(keys), k, width, task_rows, held)
    else:
        home = layout.settle(receivers, p).withColumns({"sub": F.lit(""), "bound": F.lit(float("inf"))})
        shares = _shares(placed, home, len(cell_ids), False, receiver_count, task_rows, held)
        fields = winner_fields + visit_fields + [T.StructField(n, T.DoubleType()) for n in x]
        held.append(write_stage(_meet(placed, home, shares, x, keys).applyInPandas(match_home, T.StructType(fields)), "home"))
        first = held[-1].frame.where("cell < 0").select(*[f.name for f in winner_fields])
        visits = held[-1].frame.where("cell >= 0").select("row", *x, "cell", "bound", F.lit("").alias("sub"))
    shares = _shares(placed, visits, len(cell_ids), crowded, receiver_count, task_rows, held)
    winners = _meet(placed, visits, shares, x, keys).applyInPandas(match, T.StructType(winner_fields))
    if first is not None:
        winners = first.unionByName(winners)
    rank = Window.partitionBy("row").orderBy(F.round("d2", DECIMALS), *keys)
    return winners.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).select("row", "v", "d2")


def neighbour_mean(chosen: DataFrame, weights: str) -> DataFrame:
    """Mean of the chosen donors; by inverse distance, exact matches take all the weight."""
    value = F.avg("v")
    if weights == "distance":
        d = F.sqrt("d2")
        value = F.coalesce(F.avg(F.when(F.col("d2") == 0, F.col("v"))),
                           F.try_divide(F.sum(F.try_divide(F.col("v"), d)), F.sum(F.try_divide(F.lit(1.0), d))))
    return chosen.groupBy("row").agg(value.alias("fill"))


def vectors(receivers: DataFrame, p: int) -> DataFrame:
    """(row, n, x0..): receivers of one vector have the same neighbours, so the smallest row stands for all ``n`` of them."""
    return receivers.groupBy(*_x(p)).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")).select("row", "n", *_x(p))


def hand_out(receivers: DataFrame, filled: DataFrame, p: int, task_rows: int | None = None) -> DataFrame:
    """(row, fill) of every receiver whose vector is in ``filled`` (x0.., n, fill).

    Vectors that more than a task's worth of receivers share are few, so they are sent to the receivers where these are.
    """
    x, many = _x(p), F.col("n") > F.lit(task_rows or TASK_ROWS)
    same = [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in x]

    def known(part: DataFrame) -> DataFrame:
        return part.select(*[F.col(n).alias(f"of_{n}") for n in x], "fill")

    hot = filled.where(many)
    if hot.isEmpty():
        return receivers.join(known(filled), same).select("row", "fill")
    cold = receivers.join(F.broadcast(known(hot)), same, "left_anti").join(known(filled.where(~many)), same)
    return receivers.join(F.broadcast(known(hot)), same).select("row", "fill").unionByName(cold.select("row", "fill"))


def impute_knn(df: DataFrame, key: Sequence[str], cols: Sequence[str], seen: Profile, n_neighbors: int = 5,
               weights: str = "uniform", scale: bool = True) -> DataFrame:
    """Each gap gets the mean of its nearest donors; without a common coordinate, the column mean.

    A vector that several receivers share is searched for once.
    """
    cols, key = list(cols), list(key)
    gaps = seen.with_gaps(cols)
    if not gaps:
        return df
    fallback = {n: seen.columns[n].mean for n in gaps}
    if len(cols) == 1:
        return df.withColumns({n: F.coalesce(dbl(n), F.lit(fallback[n])) for n in gaps})
    # written once, since every gap column reads it twice: what makes the columns (draws, texts) is not worked out again
    whole = stage(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    df, incomplete = whole.drop(ROW), whole.where(any_missing(gaps))
    complete = df.where(all_present(gaps))
    keys = [f"k{i}" for i in range(len(key))]
    fills = None
    for i, target in enumerate(gaps):
        others = [n for n in cols if n != target]
        vector = [standardised(n, seen, scale).alias(f"x{j}") for j, n in enumerate(others)]
        donors = df.where(c(target).isNotNull()).select(
            *vector, dbl(target).alias("v"), *[c(n).alias(a) for n, a in zip(key, keys)])
        receivers = incomplete.where(c(target).isNull()).select(c(ROW).alias("row"), *vector)
        asked = write_stage(vectors(receivers, len(others)), "vectors")
        held: list[StagedTable] = [asked]
        chosen = nearest_donors(asked.frame.drop("n"), asked.frame.count(), donors, len(others), keys, n_neighbors, len(cols), held)
        held.append(write_stage(neighbour_mean(chosen, weights), "means"))
        filled = held[-1].frame.join(asked.frame, "row")
        # written once: every use of the filled table reads the fills instead of searching again
        part = stage(hand_out(receivers, filled, len(others)).select(F.col("row").alias(ROW), F.lit(i).alias("i"), "fill"), "neighbours")
        for copy in held:
            copy.drop()
        fills = part if fills is None else fills.unionByName(part)
    wide = fills.groupBy(ROW).agg(*[F.max(F.when(F.col("i") == i, F.col("fill"))).alias(fill_name(i))
                                    for i in range(len(gaps))])
    return join_fills(complete, incomplete, wide, gaps, fallback)
