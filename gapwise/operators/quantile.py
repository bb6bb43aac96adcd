"""Exact medians and modes that never gather a whole column in one place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions.missing import c, dbl

# Buckets a column's values are counted in per round; a bracket with no more values is counted value by value.
BUCKETS = 65_536
# The first round counts on a logarithmic scale, this many buckets to a doubling.
PER_DOUBLING = 16


@dataclass
class _Bracket:
    """Values of one column between which both middle ranks lie, with what lies below and inside."""
    name: str
    ranks: tuple[int, int]
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    def bucket(self, buckets: int) -> Column:
        """A number that never falls when the value rises; null outside the bracket."""
        x = dbl(self.name)
        if self.low is None and self.inside > buckets:
            size = F.least(F.floor((F.log2(F.abs(x)) + F.lit(1075)) * F.lit(PER_DOUBLING)).cast("double") + F.lit(1.0), F.lit(1e6))
            return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size)
        at = x if self.inside <= buckets else F.floor((x - F.lit(self.low)) / F.lit(self.high - self.low) * F.lit(buckets - 1)).cast("double")
        return at if self.low is None else F.when((x >= F.lit(self.low)) & (x <= F.lit(self.high)), at)


def exact_medians(df: DataFrame, counts: dict[str, int], buckets: int = BUCKETS) -> dict[str, float]:
    """Median (mean of the middle two) of each column; ``counts`` holds the observed values per column.

    One grouped count serves all columns in a round: values are counted in buckets, before anything is shuffled, and
    the bucket that holds the middle ranks is the next bracket. The first round has a logarithmic scale, the next ones
    divide their bracket evenly, and a bracket of few values is counted by value. So one round
    serves columns of up to ``buckets`` values, two serve brackets of as many (a sixteenth of a doubling), three
    nearly all longer columns; no buffer holds a column's values, and a column's buckets are bounded.
    """
    out: dict[str, float] = {}
    active = [_Bracket(n, ((size - 1) // 2, size // 2), size) for n, size in counts.items() if size > 0]
    while active:
        found = _count(df, active, buckets)
        for b, rows in zip(active, found):
            if len(rows) > 1:  # the middle ranks are neighbours in different buckets
                out[b.name] = (rows[0]["high"] + rows[1]["low"]) / 2
            elif rows[0]["low"] == rows[0]["high"]:
                out[b.name] = rows[0]["low"]
            else:
                b.low, b.high, b.inside, b.below = (rows[0][n] for n in ("low", "high", "n", "below"))
        active = [b for b in active if b.name not in out]
    return out


def _count(df: DataFrame, brackets: Sequence[_Bracket], buckets: int) -> list[list]:
    """Per bracket the one or two buckets that hold its middle ranks, in order."""
    cells = [F.struct(F.lit(i).alias("i"), b.bucket(buckets).alias("bucket"), dbl(b.name).alias("x")) for i, b in enumerate(brackets)]
    counted = (df.select(F.inline(F.array(*cells))).where("bucket is not null").groupBy("i", "bucket")
               .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("i") + 1)
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    middle = (counted.withColumn("upto", upto + pick([b.below for b in brackets])).withColumn("below", F.col("upto") - F.col("n"))
              .where((F.col("below") <= pick([b.ranks[1] for b in brackets])) & (F.col("upto") > pick([b.ranks[0] for b in brackets]))))
    out: list[list] = [[] for _ in brackets]
    for row in middle.orderBy("i", "bucket").collect():
        out[row["i"]].append(row)
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column, smallest value on ties; one scan and one job for all columns.

    Values are counted before anything is shuffled, so one that fills a third of the table is already summed; the first
    of each column is then picked in two phases, in every task and over the tasks.
    """
    values = [f"v{i}" for i in range(len(columns))]
    if not values:
        return {}
    cells = [F.struct(F.lit(i).alias("i"), c(n).isNotNull().alias("there"), *[F.when(F.lit(i == j), c(m)).alias(v) for j, (m, v) in enumerate(zip(columns, values))])
             for i, n in enumerate(columns)]
    counted = df.select(F.inline(F.array(*cells))).where("there").groupBy("i", *values).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("i").orderBy(F.desc("n"), *values)
    top = counted.withColumn("rank", F.row_number().over(first)).where("rank = 1").collect()
    found = {r["i"]: r[values[r["i"]]] for r in top}
    return {n: found.get(i) for i, n in enumerate(columns)}
