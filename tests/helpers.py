"""Helpers of the tests; a module with a name of its own, so no other conftest hides it."""

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def to_spark(spark, pdf, schema=None):
    schema = schema or ", ".join(
        f"{n} {'long' if n == 'id' else 'double' if pdf[n].dtype.kind in 'fi' else 'string'}" for n in pdf.columns)
    rows = [tuple(None if pd.isna(v) else (int(v) if k == "id" else v) for k, v in zip(pdf.columns, r))
            for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema)


def collect(df, key="id"):
    out = df.toPandas()
    return out.sort_values(key).reset_index(drop=True) if key in out else out


def rmse(out, name):
    hit = out["__mask"]
    return float(np.sqrt(((out.loc[hit, name] - out.loc[hit, f"__truth_{name}"]) ** 2).mean()))
