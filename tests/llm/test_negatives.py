"""Hard negatives against brute force, with leaves and pieces so small that the tree has levels and pieces meet."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.llm import negatives

SHAPE = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, anchor, low=30, high=90, positives=5, count=10):
    have = {(r[0], r[2], tuple(math.floor(256 * x) for x in r[1])) for r in rows
            if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  shorter vectors end in zeros
    out = []
    for a in have:
        if anchor(a[0]):
            near = sorted((-score(a[2], b[2]), b[0]) for b in have if b[1] == a[1] and b[0] != a[0])[:positives]
            other = sorted((-score(a[2], b[2]), b[0]) for b in have if b[1] != a[1])
            for p, own in near:
                good = [o for o in other if -low * p <= -100 * o[0] <= -high * p][:count]
                out += [(a[0], own, i + 1, o[1], -p, -o[0]) for i, o in enumerate(good)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(12, size=600)] + 0.35 * rng.normal(size=(600, 8))
    x[:120] = x[0]  # one vector in a fifth of the rows
    x[200:220] *= 7  # long ones
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(4)), "mine") for i in range(600)]
    rows += rows[:5] * 3  # repeated rows
    rows += [(3, [0.5] * 8, 1, "x"), (610, None, 1, "x"), (611, [1.0] * 8, None, "x"), (None, [1.0] * 8, 1, "x"), (612, [], 2, "x"), (613, [2.0, 1.0], 3, "x"),
             (614, [float("nan")] * 8, 1, "x"), (615, [1.0, None], 1, "x"), (616, [float("inf")] * 8, 1, "x"), (617, [-1.0] * 8, 0, "x")]
    return rows


def found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"sample_rows": 64, "leaf_rows": 24, "piece_rows": 8}])
def test_equals_brute_force(spark, vectors, sizes):
    df = spark.createDataFrame(vectors, SHAPE).repartition(5)
    want = brute(vectors, lambda i: i % 20 == 0)
    assert found(negatives.hard_negatives(df, F.col("id") % 20 == 0, **sizes)) == want and len(want) > 500


def test_empty_table_and_one_label(spark, vectors):
    df = spark.createDataFrame(vectors, SHAPE)
    assert found(negatives.hard_negatives(df.limit(0), F.col("id") % 20 == 0)) == []
    assert found(negatives.hard_negatives(df.where("label = 1"), F.col("id") % 20 == 0)) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0 ** 20
    rows = [(i, [big + i, big - i, 1.0 + i], i % 2, "x") for i in range(40)]
    df = spark.createDataFrame(rows, SHAPE.replace("float", "double"))
    assert found(negatives.hard_negatives(df, F.col("id") % 10 == 0, low=0, high=100)) == brute(rows, lambda i: i % 10 == 0, 0, 100)


def test_the_tree_skips_leaves_and_finds_every_row(vectors):
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in vectors[:600]], dtype=float)
    layout = negatives.Vectors(8, "<i2", float((x * x).sum(axis=1).max()))
    tree = negatives.grow(x[::5], layout, 6)
    leaf = tree.leaf(x)
    for node in tree.nodes:
        node.low, node.high = np.full((len(node.below),) * 2, np.inf), np.full((len(node.below),) * 2, -np.inf)
    for at, child, _, d in tree.route(x):
        node = tree.nodes[at]
        node.low[:, child], node.high[:, child] = np.minimum(node.low[:, child], d.min(axis=0)), np.maximum(node.high[:, child], d.max(axis=0))
    s = layout.scores(x, x)
    length = (x * x).sum(axis=1) + layout.longest
    best = np.sort(s, axis=1)[:, -10]
    near, far = np.zeros((len(x), 1)), np.sqrt(length - 2 * best)[:, None]
    row, at = tree.reach(x, near, far)
    reached = set(zip(row.tolist(), at.tolist()))
    for i in range(len(x)):
        assert {(i, int(leaf[j])) for j in np.flatnonzero(s[i] >= best[i])} <= reached
    assert tree.leaves > 12 and len(reached) < 0.8 * tree.leaves * len(x)
