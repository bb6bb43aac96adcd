"""Hard negatives for contrastive training: an exact window search on a multiway hyperplane tree (GNAT, Brin 1995).

A node of the tree has several split points; a row belongs to the nearest of them. For each split point a node keeps
the range of distances to the rows below every sibling. A query that looks for rows between two distances skips a
sibling as soon as one range, moved by the query's own distance to that split point, misses all of its windows.

Inner products become distances by one more coordinate that brings all rows to the same length: with M the largest
squared length, |q - x|^2 = |q|^2 + M - 2 <q, x>, so a window of scores is a ring around the query.

The split points come from a bounded sample; the ranges are those of all rows, so nothing in reach is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwise.llm.common import hash_share, table
from gapwise.session import StagedTable, write_stage

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Steps a component is cut into per unit.
GRID = 256
#: Rows that may be sent to the driver to place the split points and to narrow windows; also at most this many numbers / 256.
SAMPLE_ROWS = 4096
#: Split points of a node, rows aimed at per leaf, rows that meet visitors in one piece of a leaf (about).
FAN, LEAF_ROWS, PIECE_ROWS = 16, 2048, 4096
#: Queries compared with a piece at once.
BLOCK = 256
#: Above this squared length inner products are computed in whole numbers of any size.
EXACT = 1 << 52
WIDTHS = [("smallint", "<i2", 15), ("int", "<i4", 31), ("bigint", "<i8", 63)]


def whole_vectors(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v): the rows that take part, with components floor(GRID * x)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    source = rows.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), odd.alias("odd"))
    return source.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND NOT odd").select(
        "id", "label", F.transform("x", lambda v: F.floor(v * float(GRID))).alias("v"))


@dataclass(frozen=True)
class Vectors:
    """Layout of the packed vectors: numbers a row, their type, and the largest squared length."""
    width: int
    kind: str
    longest: float

    def rows(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), dtype=self.kind).reshape(len(packed), self.width).astype(np.float64)

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.longest < EXACT:
            return (q @ x.T).astype(np.int64)
        exact = np.vectorize(int, otypes=[object])
        return np.clip(exact(q) @ exact(x).T, -(2**63), 2**63 - 1).astype(np.int64)

    def spare(self, x: np.ndarray) -> np.ndarray:
        """The added coordinate that brings every row to the same length."""
        return np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))

    @property
    def slack(self) -> float:
        return 1e-6 * np.sqrt(self.longest) + 1e-9


@dataclass
class Node:
    points: np.ndarray
    spare: np.ndarray
    below: list[int]  # a node, or ~leaf
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    vectors: Vectors
    nodes: list[Node]
    leaves: int

    def distances(self, node: Node, x: np.ndarray, spare: np.ndarray | None) -> np.ndarray:
        """From rows (with their added coordinate) or from queries (without one) to the split points."""
        inner, own = x @ node.points.T, (x * x).sum(axis=1)[:, None]
        if spare is not None:
            inner, own = inner + spare[:, None] * node.spare[None, :], self.vectors.longest
        return np.sqrt(np.maximum(0.0, own + self.vectors.longest - 2 * inner))

    def route(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child, rows that go there, their distances to all split points of the node), from the top down."""
        spare, todo = self.vectors.spare(x), [(0, np.arange(len(x)))]
        while todo and self.nodes:
            at, rows = todo.pop()
            d = self.distances(self.nodes[at], x[rows], spare[rows])
            nearest = d.argmin(axis=1)
            for child, below in enumerate(self.nodes[at].below):
                hit = nearest == child
                if hit.any():
                    yield at, child, rows[hit], d[hit]
                    if below >= 0:
                        todo.append((below, rows[hit]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        for at, child, rows, _ in self.route(x):
            if self.nodes[at].below[child] < 0:
                out[rows] = ~self.nodes[at].below[child]
        return out

    def reach(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs where a leaf may hold a row in one of the query's rings near..far (NaN: no ring)."""
        slack = self.vectors.slack
        if not self.nodes:
            return np.flatnonzero(~np.isnan(near).all(axis=1)), np.zeros(int((~np.isnan(near).all(axis=1)).sum()), dtype=np.int64)
        out, todo = [], [(0, np.arange(len(q)), np.zeros(len(q)), np.full(len(q), np.inf))]
        while todo:
            at, rows, least, most = todo.pop()
            node = self.nodes[at]
            d = self.distances(node, q[rows], None)
            for child, below in enumerate(node.below):
                lo, hi = node.low[:, child], node.high[:, child]
                if not np.isfinite(lo).all():  # no row lies there
                    continue
                lower = np.maximum(least, np.maximum(d - hi, lo - d).max(axis=1) - slack)
                upper = np.minimum(most, (d + hi).min(axis=1) + slack)
                alive = ((near[rows] <= upper[:, None]) & (far[rows] >= lower[:, None])).any(axis=1)
                if alive.any():
                    if below < 0:
                        out.append(np.stack([rows[alive], np.full(int(alive.sum()), ~below)]))
                    else:
                        todo.append((below, rows[alive], lower[alive], upper[alive]))
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        return pairs[0], pairs[1]


def grow(sample: np.ndarray, vectors: Vectors, leaf_sample: int, fan: int = FAN) -> Tree:
    """Split points taken from the sample, each far from those taken before it."""
    spare, tree = vectors.spare(sample), Tree(vectors, [], 0)

    def split(rows: np.ndarray) -> int:
        points = [rows[0]] if len(rows) else []
        least, wanted = np.full(len(rows), np.inf), min(fan, -(-len(rows) // leaf_sample))
        while len(points) < wanted:
            last = points[-1]
            least = np.minimum(least, 2 * (vectors.longest - sample[rows] @ sample[last] - spare[rows] * spare[last]))
            far = int(least.argmax())
            if least[far] <= vectors.slack**2:
                break
            points.append(rows[far])
        if len(points) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        at = len(tree.nodes)
        node = Node(sample[points], spare[points], [])
        tree.nodes.append(node)
        nearest = tree.distances(node, sample[rows], spare[rows]).argmin(axis=1)
        node.below = [split(rows[nearest == child]) for child in range(len(points))]
        return at

    if len(sample):
        split(np.arange(len(sample)))
    tree.leaves = max(1, tree.leaves)
    return tree


def _ranges(rows: DataFrame, tree: Tree) -> None:
    """Fills the distance ranges of the tree from all rows; what comes back is bounded by the size of the tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = [len(n.below) for n in tree.nodes]
        low, high = [np.full((k, k), np.inf) for k in size], [np.full((k, k), -np.inf) for k in size]
        for batch in batches:
            for at, child, _, d in tree.route(tree.vectors.rows(batch.column("v").to_pylist())) if batch.num_rows else ():
                low[at][:, child] = np.minimum(low[at][:, child], d.min(axis=0))
                high[at][:, child] = np.maximum(high[at][:, child], d.max(axis=0))
        out = [(n, i, j, low[n][i, j], high[n][i, j]) for n, k in enumerate(size) for i in range(k) for j in range(k) if np.isfinite(low[n][i, j])]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate([pa.int64()] * 3 + [pa.float64()] * 2)],
                                         names=["at", "point", "child", "lo", "hi"])

    found = rows.select("v").mapInArrow(run, "at long, point long, child long, lo double, hi double").groupBy("at", "point", "child").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for node in tree.nodes:
        k = len(node.below)
        node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for r in found.collect() if tree.nodes else ():
        tree.nodes[r["at"]].low[r["point"], r["child"]], tree.nodes[r["at"]].high[r["point"], r["child"]] = r["lo"], r["hi"]


@dataclass
class Index:
    """All rows packed by leaf in the shared folder, the tree, the sample, and the number of pieces of each leaf."""
    rows: StagedTable
    tree: Tree
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]
    pieces: np.ndarray


def index(rows: DataFrame, copies: int, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, piece_rows: int = PIECE_ROWS) -> Index:
    """Index (id, label, v) rows. Of rows with one vector and one label only the ``copies`` smallest ids can ever be
    among the first, so Spark prunes the others before any shuffle of them; rows that agree in everything are one."""
    rows = rows.dropDuplicates(["id", "label", "v"])
    same = Window.partitionBy("label", "v").orderBy("id")
    held = write_stage(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= copies).drop("place"), "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    known = held.frame.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(size).alias("longest"),
                           F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("far")).first()
    name, kind, _ = next(w for w in WIDTHS if (known["far"] or 0.0) < 2.0 ** w[2] or w[2] == 63)
    vectors = Vectors(known["width"] or 0, kind, known["longest"] or 0.0)
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(vectors.width) - F.size("v"))).cast(f"array<{name}>")
    most = max(1, min(sample_rows, sample_rows * 256 // max(1, vectors.width)))
    picked = held.frame.where(hash_share(F.xxhash64("v"), most, known["n"])).orderBy(F.xxhash64("v"), "id").limit(most).select("id", "label", full.alias("v")).collect()
    x = np.array([r["v"] for r in picked], dtype=np.float64).reshape(len(picked), vectors.width)
    sample = (x, np.array([r["id"] for r in picked], dtype=np.int64), np.array([r["label"] for r in picked], dtype=np.int64))
    tree = grow(x, vectors, max(1, leaf_rows * len(picked) // max(1, known["n"])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.compute.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).astype(kind)
            v = flat.reshape(batch.num_rows, vectors.width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in v], pa.binary()),
                                              pa.array(tree.leaf(v.astype(np.float64)), pa.int32())], names=["id", "label", "v", "leaf"])

    packed = write_stage(held.frame.select("id", "label", full.alias("v")).mapInArrow(place, "id long, label long, v binary, leaf int"), "leaves")
    held.drop()
    _ranges(packed.frame, tree)
    count = np.zeros(tree.leaves, dtype=np.int64)
    for r in packed.frame.groupBy("leaf").count().collect():
        count[r["leaf"]] = r["count"]
    return Index(packed, tree, sample, np.maximum(1, -(-count // piece_rows)))


def search(at: Index, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """(n, ring, id, score): for each query and each of its windows low[ring]..high[ring] of scores, the first ``k`` rows
    of the same label (but other ids) or of other labels, found leaf by leaf; the k best of them are the answer.

    ``queries``: n long, id long, label long, v binary, low array<long>, high array<long>.
    """
    tree, vectors, (sample, ids, labels), pieces = at.tree, at.tree.vectors, at.sample, at.pieces
    shape = "leaf int, piece int, visitor boolean, n long, id long, label long, v binary, low array<long>, high array<long>"

    def fits(label: np.ndarray, own: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which rows may answer which queries."""
        alike = label[:, None] == labels[None, :]
        return alike & (own[:, None] != ids[None, :]) if same else ~alike

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                q = vectors.rows(batch.column("v").to_pylist())
                may = fits(batch.column("label").to_numpy(), batch.column("id").to_numpy(), labels, ids)
                s = vectors.scores(q, sample)
                low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
                rings = max([1, *map(len, low)])
                near, far = np.full((len(q), rings), np.nan), np.full((len(q), rings), np.nan)
                length = (q * q).sum(axis=1) + vectors.longest
                for i in range(len(q)):
                    for w in range(len(low[i])):
                        known = s[i][may[i] & (s[i] >= low[i][w]) & (s[i] <= high[i][w])]
                        if len(known) >= k:  # k rows of the sample reach this score, so no answer lies below it
                            low[i][w] = max(low[i][w], int(np.partition(known, len(known) - k)[len(known) - k]))
                        if low[i][w] <= high[i][w]:
                            near[i, w], far[i, w] = (np.sqrt(max(0.0, length[i] - 2 * float(x))) for x in (high[i][w], low[i][w]))
                row, leaf = tree.reach(q, near, far)
                times = pieces[leaf]
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                there = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([
                    pa.array(leaf, pa.int32()), pa.array(piece, pa.int32()), pa.array(np.ones(len(row), dtype=bool)),
                    *[there.column(c) for c in ("n", "id", "label", "v")],
                    *[pa.array(x, pa.list_(pa.int64())).take(pa.array(row)) for x in (low, high)]], names=shape_names)

    shape_names = [part.split()[0] for part in shape.split(", ")]
    sizes = at.rows.frame.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(pieces)], "leaf int, pieces int")  # a row per leaf
    none = F.lit(None).cast("array<long>")
    resident = at.rows.frame.join(F.broadcast(sizes), "leaf").select(
        "leaf", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.lit(False).alias("visitor"), F.lit(None).cast("long").alias("n"),
        "id", "label", "v", none.alias("low"), none.alias("high"))
    both = resident.unionByName(queries.mapInArrow(find, shape))
    met = both.repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "visitor")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece come first and are held, its visitors follow and pass by in blocks."""
        key, parts, piece = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part, visitor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "piece", "visitor"))
            edge = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (visitor[1:] != visitor[:-1])])
            for s, e in zip(edge, np.r_[edge[1:], len(leaf)]):
                if (leaf[s], part[s]) != key:
                    key, parts, piece = (leaf[s], part[s]), [], None
                run = batch.slice(s, e - s)
                if not visitor[s]:
                    parts.append((run.column("id").to_numpy(), run.column("label").to_numpy(), vectors.rows(run.column("v").to_pylist())))
                elif parts:
                    if piece is None:
                        piece = [np.concatenate(x) for x in zip(*parts)]
                        piece = [x[np.argsort(piece[0], kind="stable")] for x in piece]
                    for start in range(0, run.num_rows, BLOCK):
                        yield answers(run.slice(start, BLOCK), *piece)

    def answers(run: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = vectors.scores(vectors.rows(run.column("v").to_pylist()), x)
        may = fits(run.column("label").to_numpy(), run.column("id").to_numpy(), labels, ids)
        n, ring, found, score = [], [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, (own, low, high) in enumerate(zip(run.column("n").to_pylist(), run.column("low").to_pylist(), run.column("high").to_pylist())):
            for w in range(len(low)):
                hit = np.flatnonzero(may[i] & (s[i] >= low[w]) & (s[i] <= high[w]))
                if len(hit):
                    hit = hit[np.argsort(-s[i][hit], kind="stable")[:k]]  # rows are in order of their ids
                    n += [own] * len(hit)
                    ring += [w] * len(hit)
                    found.append(ids[hit])
                    score.append(s[i][hit])
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(ring, pa.int32()), pa.array(np.concatenate(found)), pa.array(np.concatenate(score))],
                                          names=["n", "ring", "id", "score"])

    hits = met.mapInArrow(meet, "n long, ring int, id long, score long")
    best = Window.partitionBy("n", "ring").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **sizes: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``anchor`` (over ``key``) holds.

    Scores are whole inner products of floor(256 * x). An anchor's positives are its first ``positives`` rows of the same
    label with another key; for each, the first ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's come out, higher scores first, ties by smaller key.

    Edge cases: a row without key, label or vector, or with a null or non-finite component, takes no part; shorter vectors
    count as filled up with zeros (an empty one is all zeros); rows that agree in key, label and vector are one row; rows
    that share only the key are rows of their own, but never each other's positives; a positive below zero has no
    negatives; an empty table gives no rows; further columns are ignored. Scores outside a long are set to its ends.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    whole = whole_vectors(rows, key, vector, label)
    at = index(whole, max(positives + 1, negatives), **sizes)
    vectors = at.tree.vectors
    name = next(w[0] for w in WIDTHS if w[1] == vectors.kind)
    full = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(vectors.width) - F.size("v"))).cast(f"array<{name}>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.compute.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).astype(vectors.kind)
            v = pa.array([r.tobytes() for r in flat.reshape(batch.num_rows, vectors.width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("n", "id", "label")], v], names=["n", "id", "label", "v"])

    # only anchors move here, and they are written once, so their numbers are final
    own = whole.where(anchor).dropDuplicates(["id", "label", "v"]).withColumn("n", F.monotonically_increasing_id())
    anchors = write_stage(own.select("n", "id", "label", full.alias("v")).mapInArrow(pack, "n long, id long, label long, v binary"), "anchors").frame
    span = [F.array(F.lit(x).cast("long")) for x in (-(2**63), 2**63 - 1)]
    near = search(at, anchors.withColumns({"low": span[0], "high": span[1]}), True, positives)
    chosen = write_stage(near.select("n", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives").frame
    window = chosen.where("positive_score >= 0").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    asked = anchors.join(window, "n").select(
        "n", "id", "label", "v",
        *[F.expr(f"transform(p, x -> {share} * (x.positive_score div 100) + ({share} * (x.positive_score % 100) + {up}) div 100)").alias(end)
          for end, share, up in (("low", low, 99), ("high", high, 0))])
    found = search(at, asked, False, negatives).select("n", F.col("ring") + 1, "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = found.toDF("n", "place", "rank", "negative_id", "negative_score")
    # positives are ranked from 1 and those below zero come last, so window i belongs to the positive of rank i + 1
    placed = chosen.withColumnRenamed("rank", "place").join(anchors.select("n", F.col("id").alias("anchor_id")), "n")
    return found.join(placed, ["n", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: keys divisible by 100. Where the key is divisible by 7, the label is moved by one of ten first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


ORACLE = """
WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a, r b WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own AND id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id, own ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.own, positive_id ORDER BY score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.own, positive_id ORDER BY score DESC, s.id) <= 10
"""
