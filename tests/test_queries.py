"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from tests.helpers import SF

import __spark_entry__ as entry

QUICK = ["error_codes", "missing_profile", "usable_columns", "csv_tokens", "mask_by_rule", "inject_mcar", "inject_mar", "inject_mnar",
         "keep_one", "default_spec", "listwise", "drop_columns", "pairwise_corr", "impute_median", "impute_mode", "indicator",
         "pattern_statistics", "impute_regression_2", "impute_regression_gaps", "impute_regression_noise",
         "impute_iterative", "impute_em", "impute_em_three", "impute_multiple", "pooled", "histogram_shared", "rmse_truth",
         "dropped_shown", "imputed_values", "gaps_on_top", "method_comparison", "full_report", "forest_squares", "boosting_groups",
         "report_cells", "report_notes", "impute_em_gaps", "chain_two_gaps"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    as_text = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(tuple(as_text(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_two_gap_forest_runs_with_the_default_parameters(monkeypatch):
    from gapwise.workload import queries

    monkeypatch.setattr(queries, "_held_rules", lambda spark, d, method, params: (method, params))
    assert queries.QUERIES["forest_two_gaps"](None, "") == ("random_forest", {})


def test_forest_squares_keeps_all_sizes(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, (i % 50 + 1)::INTEGER AS p_size FROM range(2500) t(i)")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got, want = entry.queries()["forest_squares"](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()["forest_squares"]).fetchdf()
    assert got["p_size"].nunique() == got["area"].nunique() == 50 and got["mask"].any()
    assert rows(got) == rows(want)
