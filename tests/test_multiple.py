"""Multiple imputation with several gap columns: how its result is put together."""

import numpy as np

from gapwise import impute


def test_several_gap_columns_need_no_join(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3)) @ np.array([[1, 0.6, 0.3], [0, 1, 0.5], [0, 0, 1]])
    gap = rng.random((900, 2)) < 0.25
    rows = [(i // 2, None if gap[i, 0] else float(a), None if gap[i, 1] else float(b), float(d), f"t{i}") for i, (a, b, d) in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, note string")  # every key twice
    runs = impute(df, "multiple", {"m": 3, "max_iter": 2}, 5, "k").extras["runs"]
    plan = runs.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
    out = runs.frame.toPandas().sort_values("note", key=lambda s: s.str[1:].astype(int))
    assert out["note"].tolist() == [r[4] for r in rows] and not out[["a", "b"]].isna().any().any()
    for j, n in enumerate("ab"):
        assert np.array_equal(out[n].to_numpy()[~gap[:, j]], x[~gap[:, j], j])
        assert out[f"__runs_{n}"].isna().to_numpy().tolist() == (~gap[:, j]).tolist()
        values = np.stack(out[f"__runs_{n}"].to_numpy()[gap[:, j]])
        assert values.shape[1] == 3 and (values.std(axis=1) > 0).all() and np.array_equal(values[:, 0], out[n].to_numpy()[gap[:, j]])
