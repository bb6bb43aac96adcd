"""Trees on cells of binned predictors: what must come out, and that no round passes over the rows."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gapwise.operators import forest, trees
from gapwise.operators.cuts import cut_points


def made(spark, rows=6000):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=rows).round(3), rng.integers(0, 9, rows)
    y = np.where(a > 0.3, 5.0, a) + b**2 + rng.normal(size=rows)
    return spark.createDataFrame([(int(i), float(p), float(q), float(v)) for i, (p, q, v) in enumerate(zip(a, b, y))],
                                 f"k long, u double, v double, {trees.LABEL} double")


def test_boosting_on_cells_equals_boosting_on_rows(spark, monkeypatch):
    df = made(spark)
    fit, seen = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *more: (seen.append(data.count()), fit(self, data, *more))[1])
    model = trees.boosted_trees(0, rounds=8)(df, ["u", "v"], ["k"], 6000)
    assert seen[0] <= 255 * 9 < 6000
    plain = fit(GBTRegressor(featuresCol="x", labelCol=trees.LABEL, predictionCol="p", maxIter=8, stepSize=0.1, maxDepth=5, maxBins=255,
                             minInstancesPerNode=20, seed=0), VectorAssembler(inputCols=["u", "v"], outputCol="x").transform(df))
    both = plain.transform(VectorAssembler(inputCols=["u", "v"], outputCol="x").transform(df)).select("k", "u", "v", "p")
    out = model.transform(both, "q", F.lit(True)).toPandas()
    assert np.allclose(out["p"], out["q"], rtol=1e-9)


def test_forest_of_cells_needs_no_pass_per_level_and_no_layout(spark):
    df = made(spark)
    one, other = (trees.random_forest(20, 3)(part, ["u", "v"], ["k"], 6000) for part in (df.coalesce(1), df.repartition(7)))
    assert isinstance(one, forest.CellForest) and len(one.trees) == 20
    out = one.transform(df, "p", F.lit(True)).toPandas()
    assert np.allclose(out["p"], other.transform(df, "q", F.lit(True)).toPandas()["q"], rtol=1e-9)
    truth = np.where(out["u"] > 0.3, 5.0, out["u"]) + out["v"] ** 2
    assert np.sqrt(((out["p"] - truth) ** 2).mean()) < 0.5 < 5 * 0.5 < truth.std()


def test_wide_tables_take_the_rows_themselves(spark, monkeypatch):
    monkeypatch.setattr(forest, "MAX_CELLS", 100)
    assert isinstance(trees.random_forest(3, 3, 4)(made(spark, 500), ["u", "v"], ["k"], 500), trees.SparkModel)


def test_grown_tree_is_the_best_at_every_node():
    rng = np.random.default_rng(1)
    bins = np.array([(i, j) for i in range(6) for j in range(4)])
    weight, label = rng.integers(1, 5, 24).astype(float), rng.normal(size=24)
    tree = forest.grow(bins, weight, weight * label, [6, 4], 1)

    def loss(f, at):
        parts = [bins[:, f] <= at, bins[:, f] > at]
        return sum((weight[p] * (label[p] - np.average(label[p], weights=weight[p])) ** 2).sum() for p in parts)

    options = {(f, at): loss(f, at) for f, r in enumerate((6, 4)) for at in range(r - 1)}
    assert (tree.feature[0], tree.cut[0]) == min(options, key=options.get)
    deep = forest.grow(bins, weight, weight * label, [6, 4], 30)
    assert np.allclose(deep.predict(bins), label)


def test_bootstrap_weights_and_cuts():
    draws = forest.bootstrap(np.arange(40_000) * 7919, 6, 5)
    assert draws.shape == (6, 40_000) and np.allclose(draws.mean(axis=1), 1, atol=0.03) and np.allclose(draws.var(axis=1), 1, atol=0.05)
    assert abs(np.corrcoef(draws)[np.triu_indices(6, 1)]).max() < 0.03
    assert cut_points(np.array([1.0, 1, 2, 4]), 10).tolist() == [1.5, 3.0]
    assert len(cut_points(np.arange(1000.0), 10)) == 9
