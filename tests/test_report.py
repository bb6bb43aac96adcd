"""Reports on the orders and on labelled documents."""

import numpy as np
import pytest
from tests.helpers import SF, collect, rmse
from pyspark.sql import functions as F

from gapwise import EngineError, analyse, compare_methods, inject_missing
from gapwise.functions.correlation import correlation_matrix
from gapwise.plans.report import BINS, describe, shared_histogram

KEY = "o_orderkey"
ASK = {"mechanism": "MNAR", "rate": 0.25, "target": "o_totalprice"}


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents with the labels that some of them have: native gaps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    return docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").cache()


def test_report_with_truth_agrees_with_pandas(orders):
    r = analyse(orders, KEY, "median", {}, ASK, seed=3)
    before, after = collect(r.before, KEY), collect(r.after, KEY)
    gaps = int(before["o_totalprice"].isna().sum())
    assert r.has_truth and r.column == "o_totalprice" and r.missing_cells() == (gaps, 0)
    row = {x["column"]: x for x in r.stats().collect()}["o_totalprice"]
    assert row["rmse"] == pytest.approx(rmse(before.assign(o_totalprice=after["o_totalprice"]), "o_totalprice"))
    assert row["missing"] == gaps and row["truth_n"] == len(before)
    cells = r.cells(None).toPandas()
    assert len(cells) == gaps and sorted(cells["truth"]) == pytest.approx(sorted(before.loc[before["__mask"], "__truth_o_totalprice"]))
    hist = r.histogram().toPandas().groupby("series")["n"].sum()
    assert hist["truth"] == hist["after"] == len(before) == hist["before"] + gaps
    assert r.corr_before().count() == r.corr_truth().count() == 4 and r.dropped().isEmpty()


def test_native_gaps_are_not_added_to(labelled):
    r = analyse(labelled, "doc_id", "listwise", missing=ASK | {"target": "n_chars"})
    unlabelled = labelled.where("quality IS NULL").count()
    assert r.has_native_missing and not r.has_truth and r.applied is None if hasattr(r, "applied") else r.missing_applied is None
    assert r.notes and r.column == "quality" and r.dropped(None).count() == unlabelled
    assert r.shape_after()[0] == labelled.count() - unlabelled
    assert {x["rmse"] for x in r.stats().collect()} == {None}


def test_focus_follows_the_question(labelled):
    assert analyse(labelled, "doc_id", column="toxic").column == "toxic"
    assert analyse(labelled, "doc_id", column="lang").column == "quality"
    assert analyse(labelled.select("doc_id", "lang", "n_chars"), "doc_id").column == "n_chars"


def test_runs_show_the_spread_of_cells(orders):
    r = analyse(orders, KEY, "multiple", {"m": 3, "max_iter": 2}, ASK)
    assert all(x["sd"] > 0 for x in r.cells(None).collect())


def test_a_target_that_is_dropped_has_no_after(orders):
    r = analyse(orders, KEY, "drop_columns", {"max_missing_pct": 1}, ASK)
    row = {x["column"]: x for x in r.stats().collect()}["o_totalprice"]
    assert row["after_n"] is None and row["rmse"] is None and "o_totalprice" not in r.after.columns
    assert set(r.histogram().toPandas()["series"]) == {"before", "truth"}


def test_nothing_left(orders):
    bare = orders.withColumns({"o_custkey": F.when(F.col(KEY) > 5, F.col("o_custkey")), "o_totalprice": F.when(F.col(KEY) <= 5, F.col("o_totalprice"))})
    r = analyse(bare, KEY, "listwise")
    assert r.shape_after()[0] == 0 and r.stats().count() == 2 and r.notes


@pytest.mark.parametrize("seed", ["one", 1.5])
def test_seeds_are_whole_numbers(orders, seed):
    with pytest.raises(EngineError) as caught:
        analyse(orders, KEY, seed=seed)
    assert caught.value.code == "bad_param"


def test_histogram_bins(orders):
    pdf = collect(orders, KEY)
    half = orders.select((F.col("o_totalprice") / 2).alias("half"))
    got = shared_histogram({"all": (orders, F.col("o_totalprice")), "half": (half, F.col("half"))}).toPandas()
    both = np.r_[pdf["o_totalprice"], pdf["o_totalprice"] / 2]
    edges = np.linspace(both.min(), both.max(), BINS + 1)
    for name, values in (("all", pdf["o_totalprice"]), ("half", pdf["o_totalprice"] / 2)):
        assert got[got["series"] == name].sort_values("bin")["n"].tolist() == np.histogram(values, bins=edges)[0].tolist()
    flat = shared_histogram({"one": (orders, F.lit(-3.0))}).toPandas()
    assert (flat["low"].min(), flat["high"].max(), flat["n"].sum()) == (-3.5, -2.5, len(pdf))
    assert shared_histogram({"none": (orders, F.lit(None).cast("double"))}) is None


def test_undefined_statistics_are_null(orders):
    got = {(r["col_a"], r["col_b"]): r["value"] for r in correlation_matrix(orders.withColumn("same", F.lit(2.0)), ["o_totalprice", "same"]).collect()}
    assert got["o_totalprice", "o_totalprice"] == 1.0 and got["same", "same"] is None is got["o_totalprice", "same"]
    row = describe(orders.orderBy(KEY).limit(1), ["o_totalprice"]).first()
    assert row["n"] == 1 and row["std"] is None


def test_comparison_ranks_methods(lines):
    df = inject_missing(lines.select("line", "price", "net"), "line", "net", seed=9)
    rows = {r["label"]: r["rmse"] for r in compare_methods(df, "line", "net", {
        "flat": ("median", {}), "line": ("regression", {}), "whole rows": ("listwise", {})}).collect()}
    assert rows["line"] < 0.5 * rows["flat"] and rows["whole rows"] is None
