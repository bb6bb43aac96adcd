"""The registered queries: every operator on the whole of a given table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.errors import EngineError
from gapwise.functions.correlation import correlation_matrix
from gapwise.functions.draws import hash_uniform
from gapwise.functions.missing import GAPS, MASK, c, data_columns, numeric_columns, profile, truth_name
from gapwise.operators.inject import inject_missing, mask_where, resolve_missing
from gapwise.operators.knn import standardised
from gapwise.operators.moments import pattern_sums
from gapwise.plans.compare import compare_methods
from gapwise.plans.registry import impute
from gapwise.plans.report import (align_truth, analyse, describe, dropped_rows, gaps_first, head, imputed_cells,
                                  missing_counts, relative_deviation, rmse, shared_histogram, surviving_gap_rows)
from gapwise.session import shared_dir
from gapwise.sources.tables import load_dataset, read_csv_table, validate_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SEED = 7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


# ------------------------------------------------------------------ inputs

def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def orders_mcar(spark: SparkSession, d: str) -> DataFrame:
    return inject_missing(orders(spark, d), "o_orderkey", "o_totalprice", "MCAR", 0.3, seed=SEED)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, d, "labels"), "doc_id", "left")


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                               words.cast("double").alias("n_words"))


def document_sizes_mcar(spark: SparkSession, d: str) -> DataFrame:
    return inject_missing(document_sizes(spark, d), "doc_id", "n_words", "MCAR", 0.3, seed=SEED)


def prices(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        *LINE_KEY, F.col("l_extendedprice").alias("price"), net.alias("net"),
        (net * (1 + F.col("l_tax"))).alias("charge"), F.col("l_quantity").alias("qty"))


def prices_mcar(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """price and/or qty as predictors, ``net`` with 30 % of its values removed."""
    return inject_missing(prices(spark, d).select(*LINE_KEY, *columns, "net"), LINE_KEY, "net", "MCAR", 0.3, seed=SEED)


def prices_two_gaps(spark: SparkSession, d: str, with_truth: bool = False) -> DataFrame:
    """Independent gaps in ``net`` and ``charge``: four patterns."""
    df = prices(spark, d)
    if with_truth:
        df = df.withColumns({truth_name(n): c(n) for n in ("net", "charge")})
    for name in ("net", "charge"):
        df = mask_where(df, name, hash_uniform(LINE_KEY, name, SEED) < 0.25)
    return df


def gappy_events(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    df = mask_where(df, "value", F.col("event_type") == "error")
    df = mask_where(df, "user_id", hash_uniform(["event_id"], "user_id", SEED) < 0.2)
    return mask_where(df, "event_type", hash_uniform(["event_id"], "event_type", SEED) < 0.25)


# ------------------------------------------------------------------ scans, masks, injection

@query
def missing_profile(spark, d):
    df = labelled_documents(spark, d)
    return missing_counts(df, ["lang", "source", "n_chars", "quality", "toxic"])


@query
def usable_columns(spark, d):
    """Numeric columns, their observed values, and whether a model may use them; one column is emptied."""
    df = labelled_documents(spark, d).withColumn("toxic", F.lit(None).cast("double"))
    names = numeric_columns(df, "doc_id")
    counts = missing_counts(df, names)
    return counts.select("column", (F.col("rows") - F.col("missing")).alias("n"),
                         (F.col("rows") > F.col("missing")).alias("usable"))


@query
def table_shapes(spark, d):
    """Rows and data columns before and after two deletion methods."""
    df = labelled_documents(spark, d)
    out = None
    for label, method in (("before", "none"), ("listwise", "listwise"), ("drop_columns", "drop_columns")):
        frame = impute(df, method, key="doc_id").frame
        width = len(data_columns(frame, "doc_id"))
        part = frame.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(label).alias("side"), "n_rows",
                                                                   F.lit(width).cast("long").alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def csv_tokens(spark, d):
    """Events written as text with several spellings of "missing", and read back with types."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    text = table(spark, d, "events").select(
        "event_id", "user_id", F.when(kind == "click", F.lit("null")).otherwise(kind).alias("event_type"),
        F.when(kind == "error", "NA").when(kind == "signup", "?").otherwise(value).alias("value"))
    path = f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    text.write.csv(path, header=True, sep=";")
    return read_csv_table(spark, path)


@query
def csv_texts(spark, d):
    """Whole documents written as quoted text (separators, quotes and line breaks inside) and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv_table(spark, path, multiline=True)


@query
def error_codes(spark, d):
    """Requests on the given tables that must be refused, and with which code; parameters out of range are only moved."""
    o, gappy, names = orders(spark, d), orders_mcar(spark, d), table(spark, d, "nation").select("n_name")
    sparse = gappy.select("o_orderkey", "o_totalprice")
    asked = {
        "header twice": lambda: validate_frame(o.select("o_custkey", "o_custkey")),
        "header blank": lambda: validate_frame(o.withColumnRenamed("o_custkey", " ")),
        "no rows": lambda: validate_frame(o.where("o_orderkey < 0")),
        "row limit": lambda: validate_frame(o, max_rows=10),
        "column limit": lambda: validate_frame(o, max_columns=2),
        "texts only": lambda: validate_frame(names),
        "kind of source": lambda: load_dataset(spark, {"kind": "cards"}),
        "name of source": lambda: load_dataset(spark, {"kind": "table", "name": "no_such_table"}),
        "mechanism": lambda: inject_missing(o, "o_orderkey", "o_totalprice", "MXAR"),
        "rate": lambda: inject_missing(o, "o_orderkey", "o_totalprice", rate=1.0),
        "gaps before": lambda: inject_missing(sparse, "o_orderkey", "o_totalprice"),
        "target": lambda: inject_missing(o, "o_orderkey", "o_nothing"),
        "driver": lambda: inject_missing(o, "o_orderkey", "o_totalprice", "MAR", driver="o_totalprice"),
        "method": lambda: impute(sparse, "guess", key="o_orderkey"),
        "fill value": lambda: impute(sparse, "constant", {"fill_value": "much"}, key="o_orderkey"),
        "neighbours": lambda: impute(sparse, "knn", {"n_neighbors": "two"}, key="o_orderkey"),
        "weights": lambda: impute(gappy, "knn", {"weights": "equal"}, key="o_orderkey"),
        "no key": lambda: impute(gappy, "knn"),
        "nothing left": lambda: impute(sparse, "drop_columns", {"max_missing_pct": -5}, key="o_orderkey"),
        "model on texts": lambda: impute(names, "regression"),
        "rounds below one": lambda: impute(gappy, "iterative", {"max_iter": 0}, key="o_orderkey"),
    }
    out = []
    for name, request in asked.items():
        try:
            out.append((name, f"{len(getattr(request(), 'notes', []))} note"))
        except EngineError as exc:
            out.append((name, exc.code))
    return spark.createDataFrame(out, "request string, code string")


@query
def mask_by_rule(spark, d):
    df = mask_where(table(spark, d, "events").select("event_id", "event_type", "value"), "value",
                    F.col("event_type") == "error")
    return df


def _injected(df: DataFrame, key: str, target: str) -> DataFrame:
    return df.select(key, target, c(truth_name(target)).alias("truth"), c(MASK).alias("mask"))


@query
def inject_mcar(spark, d):
    return _injected(orders_mcar(spark, d), "o_orderkey", "o_totalprice")


@query
def inject_mar(spark, d):
    df = inject_missing(orders(spark, d), "o_orderkey", "o_totalprice", "MAR", 0.3, "o_custkey", SEED)
    return _injected(df, "o_orderkey", "o_totalprice")


@query
def inject_mnar(spark, d):
    df = inject_missing(orders(spark, d), "o_orderkey", "o_totalprice", "MNAR", 0.3, seed=SEED)
    return _injected(df, "o_orderkey", "o_totalprice")


@query
def keep_one(spark, d):
    """A rate above every possible draw removes all values but one."""
    df = inject_missing(customers(spark, d), "c_custkey", "c_acctbal", "MCAR", 0.9999999999, seed=SEED)
    return _injected(df, "c_custkey", "c_acctbal")


@query
def default_spec(spark, d):
    spec = resolve_missing(table(spark, d, "lineitem"), LINE_KEY)
    return spark.createDataFrame([(spec["mechanism"], spec["rate"], spec["target"], spec["driver"])],
                                 "mechanism string, rate double, target string, driver string")


# ------------------------------------------------------------------ deletion

@query
def listwise(spark, d):
    return impute(labelled_documents(spark, d), "listwise", key="doc_id").frame


@query
def drop_columns(spark, d):
    return impute(labelled_documents(spark, d), "drop_columns", {"max_missing_pct": 30}, key="doc_id").frame


@query
def pairwise_corr(spark, d):
    parts = impute(gappy_events(spark, d), "pairwise", key="event_id").extras
    out = None
    for kind, value in (("corr_pairwise", "value"), ("corr_listwise", "value"), ("n_pairwise", "n")):
        part = parts[kind].select(F.lit(kind).alias("kind"), "col_a", "col_b",
                                  rounded(F.col(value).cast("double")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def no_method(spark, d):
    return impute(orders_mcar(spark, d), "none", key="o_orderkey").frame.select("o_orderkey", "o_totalprice")


# ------------------------------------------------------------------ one value per column

def _filled_orders(spark, d, method, params=None):
    out = impute(orders_mcar(spark, d), method, params, key="o_orderkey").frame
    return out.select("o_orderkey", rounded("o_totalprice", 4).alias("o_totalprice"))


@query
def impute_mean(spark, d):
    return _filled_orders(spark, d, "mean")


@query
def impute_median(spark, d):
    return _filled_orders(spark, d, "median")


@query
def impute_constant(spark, d):
    return _filled_orders(spark, d, "constant", {"fill_value": -1.5})


@query
def impute_mode(spark, d):
    out = impute(gappy_events(spark, d), "most_frequent", key="event_id").frame
    return out.select("event_id", "event_type", "user_id", "value")


@query
def indicator(spark, d):
    out = impute(labelled_documents(spark, d), "mean", {"add_indicator": True}, key="doc_id").frame
    return out.select("doc_id", "n_chars", rounded("quality").alias("quality"), rounded("toxic").alias("toxic"),
                      "quality_missing", "toxic_missing")


# ------------------------------------------------------------------ neighbours

@query
def standardize(spark, d):
    df = customers(spark, d)
    seen = profile(df, ["c_nationkey", "c_acctbal"], ["c_nationkey", "c_acctbal"])
    return df.select("c_custkey", *[rounded(standardised(n, seen)).alias(n) for n in ("c_nationkey", "c_acctbal")])


def _knn_customers(spark, d, weights):
    df = inject_missing(customers(spark, d), "c_custkey", "c_acctbal", "MCAR", 0.3, seed=SEED)
    out = impute(df, "knn", {"n_neighbors": 5, "weights": weights}, key="c_custkey").frame
    return out.select("c_custkey", rounded("c_acctbal", 4).alias("c_acctbal"))


@query
def impute_knn_uniform(spark, d):
    return _knn_customers(spark, d, "uniform")


@query
def impute_knn_distance(spark, d):
    df = inject_missing(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size",
                        "MCAR", 0.3, seed=SEED)
    out = impute(df, "knn", {"n_neighbors": 5, "weights": "distance"}, key="p_partkey").frame
    return out.select("p_partkey", rounded("p_size", 4).alias("p_size"))


@query
def impute_knn_orders(spark, d):
    out = impute(orders_mcar(spark, d), "knn", {"n_neighbors": 5}, key="o_orderkey").frame
    return out.select("o_orderkey", rounded("o_totalprice", 2).alias("o_totalprice"))


@query
def impute_knn_gaps(spark, d):
    """Three numeric columns, two of them with gaps, so distances run over the coordinates both rows have."""
    df = gappy_events(spark, d).select("event_id", "user_id", "value", "k")
    out = impute(df, "knn", {"n_neighbors": 5}, key="event_id").frame
    return out.select("event_id", *[rounded(n, 4).alias(n) for n in ("user_id", "value")], "k")


@query
def impute_knn_cells(spark, d):
    """Two columns with gaps, donors with gaps of their own, three coordinates per distance."""
    return _fills(prices_two_gaps(spark, d), "knn", {"n_neighbors": 5}, ("net", "charge"), 2)


# ------------------------------------------------------------------ models

@query
def pattern_statistics(spark, d):
    cols = ["price", "net", "charge"]
    df = prices_two_gaps(spark, d)
    seen = profile(df, cols, cols)
    sums = pattern_sums(df, cols, ["net", "charge"], [seen.columns[n].mean for n in cols])
    n = F.col("n")
    return sums.select(
        "pattern", "n", *[rounded(F.col(f"s_{i}") / n / 1e4).alias(f"s_{i}") for i in range(3)],
        *[rounded(F.col(f"q_{i}_{j}") / n / 1e8).alias(f"q_{i}_{j}") for i in range(3) for j in range(i, 3)])


def _fills(df: DataFrame, method: str, params: dict | None, names: tuple[str, ...], digits: int = 1,
           seed: int = 0) -> DataFrame:
    """Observed cells as they are, filled cells rounded (engines differ in the last bits of a sum)."""
    out = impute(df, method, params, seed, LINE_KEY, track=True).frame
    cells = [F.when(F.array_contains(c(GAPS), n), rounded(n, digits)).otherwise(c(n)).alias(n) for n in names]
    return out.select(*LINE_KEY, *cells)


@query
def impute_regression_1(spark, d):
    return _fills(prices_mcar(spark, d, "price"), "regression", {}, ("net",))


@query
def impute_regression_2(spark, d):
    return _fills(prices_mcar(spark, d, "price", "qty"), "regression", {}, ("net",))


@query
def impute_regression_gaps(spark, d):
    """Predictors have gaps themselves and are mean-filled."""
    df = prices_two_gaps(spark, d).select(*LINE_KEY, "net", "charge")
    return _fills(df, "regression", {}, ("net", "charge"))


@query
def impute_regression_noise(spark, d):
    return _fills(prices_mcar(spark, d, "price"), "regression", {"stochastic": True}, ("net",), seed=SEED)


@query
def impute_iterative(spark, d):
    return _fills(prices_mcar(spark, d, "price"), "iterative", {}, ("net",))


@query
def impute_iterative_gaps(spark, d):
    return _fills(prices_two_gaps(spark, d), "iterative", {}, ("net", "charge"))


@query
def impute_em(spark, d):
    return _fills(prices_mcar(spark, d, "price"), "em", {}, ("net",))


@query
def impute_em_gaps(spark, d):
    return _fills(prices_two_gaps(spark, d), "em", {}, ("net", "charge"))


@query
def impute_em_three(spark, d):
    """One complete column and two with gaps: four patterns with a regression each in every round."""
    df = prices_two_gaps(spark, d).select(*LINE_KEY, "price", "net", "charge")
    return _fills(df, "em", {}, ("net", "charge"))


@query
def impute_random_forest(spark, d):
    return _fills(prices_mcar(spark, d, "price", "qty"), "random_forest", {}, ("net",))


@query
def impute_gradient_boosting(spark, d):
    return _fills(prices_mcar(spark, d, "price", "qty"), "gradient_boosting", {}, ("net",))


@query
def forest_squares(spark, d):
    """A forest whose answer is known: the square of a number with 50 values, so every filled cell equals the truth.

    It holds where every size is observed often enough to be in each bootstrap sample (sf 0.01 and up)."""
    df = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") * F.col("p_size")).cast("double").alias("area"))
    df = inject_missing(df, "p_partkey", "area", "MCAR", 0.3, seed=SEED)
    out = impute(df, "random_forest", key="p_partkey").frame
    return out.select("p_partkey", "p_size", rounded("area").alias("area"), c(MASK).alias("mask"))


@query
def boosting_groups(spark, d):
    """Boosting whose answer is known: five predictor values, so a filled cell is the mean of its observed group."""
    df = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("level"), F.col("p_partkey").cast("double").alias("number"))
    df = inject_missing(df, "p_partkey", "number", "MCAR", 0.3, seed=SEED)
    out = impute(df, "gradient_boosting", key="p_partkey").frame
    return out.select("p_partkey", "level", rounded("number", 4).alias("number"))


def _held_rules(spark, d, method: str, params: dict) -> DataFrame:
    """What must hold with two gap columns: no gap stays, no observed cell changes, the error is well below the mean's."""
    names = ("net", "charge")
    before = prices_two_gaps(spark, d, with_truth=True)  # the truth travels as a column: the key need not be unique
    out = impute(before, method, params, key=LINE_KEY, track=True).frame
    seen = before.agg(*[F.avg(n).alias(n) for n in names]).first()
    left, changed, better = F.lit(0), F.lit(0), F.lit(True)
    for n in names:
        gap, exact = F.array_contains(c(GAPS), n), c(truth_name(n))
        left, changed = left + F.count_if(c(n).isNull()), changed + F.count_if(~gap & (c(n) != exact))
        squares = [F.sum(F.when(gap, F.pow(x - exact, F.lit(2.0)))) for x in (c(n), F.lit(seen[n]))]
        better = better & (F.sqrt(squares[0]) < 0.6 * F.sqrt(squares[1]))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), left.alias("gaps_left"), changed.alias("changed"),
                   better.alias("better_than_mean"))


@query
def forest_two_gaps(spark, d):
    return _held_rules(spark, d, "random_forest", {})


@query
def chain_two_gaps(spark, d):
    return _held_rules(spark, d, "iterative", {})


@query
def spread_two_gaps(spark, d):
    """Multiple imputation of two gap columns: the runs agree on observed cells and differ on filled ones."""
    runs = impute(prices_two_gaps(spark, d), "multiple", {"m": 3, "max_iter": 2}, SEED, LINE_KEY).extras["runs"]
    gap = {n: hash_uniform(LINE_KEY, n, SEED) < 0.25 for n in ("net", "charge")}
    sd = {n: runs.spread_of(n) for n in gap}
    return runs.frame.agg(F.count(F.lit(1)).alias("n_rows"),
                          sum((F.count_if(~gap[n] & (sd[n] != 0)) for n in gap), F.lit(0)).alias("spread_on_observed"),
                          sum((F.count_if(gap[n] & ~(sd[n] > 0)) for n in gap), F.lit(0)).alias("gaps_without_spread"))


@query
def impute_multiple(spark, d):
    runs = impute(document_sizes_mcar(spark, d), "multiple", seed=SEED, key="doc_id").extras["runs"]
    return runs.frame.select("doc_id", rounded("n_words", 3).alias("n_words"),
                             rounded(runs.spread_of("n_words"), 3).alias("sd"))


@query
def pooled(spark, d):
    runs = impute(document_sizes_mcar(spark, d), "multiple", seed=SEED, key="doc_id").extras["runs"]
    return runs.pooled().select("column", rounded("pooled_mean", 4).alias("pooled_mean"),
                                rounded("between_sd", 4).alias("between_sd"))


@query
def impute_multiple_gaps(spark, d):
    df = prices_two_gaps(spark, d)
    runs = impute(df, "multiple", {"m": 3, "max_iter": 3}, SEED, LINE_KEY).extras["runs"]
    return runs.frame.select(
        *LINE_KEY, *[rounded(n, 1).alias(n) for n in ("net", "charge")],
        *[rounded(runs.spread_of(n), 1).alias(f"{n}_sd") for n in ("net", "charge")])


# ------------------------------------------------------------------ reports

@query
def describe_before_after(spark, d):
    before = orders_mcar(spark, d)
    after = impute(before, "mean", key="o_orderkey").frame
    truth = {"o_totalprice": c(truth_name("o_totalprice"))}
    sides = {"before": describe(before, ["o_custkey", "o_totalprice"]),
             "after": describe(after, ["o_custkey", "o_totalprice"]),
             "truth": describe(before, ["o_custkey", "o_totalprice"], truth)}
    out = None
    for name, part in sides.items():
        part = part.select(F.lit(name).alias("side"), "column", "n",
                           *[rounded(s, 4).alias(s) for s in ("mean", "std", "min", "max")])
        out = part if out is None else out.unionByName(part)
    return out


@query
def histogram_shared(spark, d):
    before = orders_mcar(spark, d)
    after = impute(before, "median", key="o_orderkey").frame
    hist = shared_histogram({"before": (before, F.col("o_totalprice")), "after": (after, F.col("o_totalprice")),
                             "truth": (before, c(truth_name("o_totalprice")))})
    return hist.select("series", "bin", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "n")


@query
def rmse_truth(spark, d):
    """Error of three methods; the truth comes from the original table by row key for the last one."""
    before = orders_mcar(spark, d)
    out = None
    for method in ("mean", "none", "listwise"):
        part = rmse(impute(before, method, key="o_orderkey").frame, ["o_totalprice"])
        part = part.select(F.lit(method).alias("method"), rounded("rmse", 4).alias("rmse"))
        out = part if out is None else out.unionByName(part)
    median = impute(before, "median", key="o_orderkey").frame.drop(truth_name("o_totalprice"))
    joined = align_truth(median, orders(spark, d), ["o_orderkey"], "o_totalprice")
    return out.unionByName(rmse(joined, ["o_totalprice"]).select(F.lit("median").alias("method"),
                                                                rounded("rmse", 4).alias("rmse")))


@query
def deviation(spark, d):
    before = orders_mcar(spark, d)
    after = describe(impute(before, "median", key="o_orderkey").frame, ["o_totalprice"])
    truth = describe(before, ["o_totalprice"], {"o_totalprice": c(truth_name("o_totalprice"))})
    pair = after.alias("a").join(truth.alias("t"), "column")
    return pair.select("column", *[
        rounded(relative_deviation(F.col(f"a.{s}"), F.col(f"t.{s}")), 4).alias(s) for s in ("mean", "std", "min", "max")])


@query
def correlation_before_after(spark, d):
    cols = ["price", "net", "charge", "qty"]
    before = prices_two_gaps(spark, d)
    after = impute(before, "mean", key=LINE_KEY).frame
    out = None
    for side, df in (("before", before), ("after", after), ("truth", prices(spark, d))):
        part = correlation_matrix(df, cols).select(F.lit(side).alias("side"), "col_a", "col_b", "n",
                                                   rounded("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def dropped_documents(spark, d):
    before = labelled_documents(spark, d)
    after = impute(before, "listwise", key="doc_id").frame
    return dropped_rows(before, after, ["doc_id"], limit=None)


@query
def dropped_shown(spark, d):
    before = labelled_documents(spark, d)
    after = impute(before, "listwise", key="doc_id").frame
    return dropped_rows(before, after, ["doc_id"])


@query
def surviving_gaps(spark, d):
    before = gappy_events(spark, d)
    after = before.where(F.col("event_type").isNotNull())
    return surviving_gap_rows(before, after, ["event_id"], "value")


@query
def imputed_values(spark, d):
    out = impute(orders_mcar(spark, d), "mean", key="o_orderkey", track=True).frame
    return imputed_cells(out, ["o_orderkey"]).select(
        "o_orderkey", "column", rounded("value", 4).alias("value"), rounded("truth", 4).alias("truth"))


@query
def first_rows(spark, d):
    return head(orders_mcar(spark, d), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def gaps_on_top(spark, d):
    df = orders_mcar(spark, d).drop(MASK, truth_name("o_totalprice"))
    return gaps_first(df, ["o_orderkey"]).select("position", "o_orderkey", "o_totalprice")


@query
def method_comparison(spark, d):
    out = compare_methods(prices_mcar(spark, d, "price"), LINE_KEY, "net", {
        "mean": ("mean", {}), "median": ("median", {}), "regression": ("regression", {}),
        "constant": ("constant", {"fill_value": 0}), "none": ("none", {})})
    return out.select("label", *[rounded(s, 4).alias(s) for s in ("rmse", "mean", "std")])


@query
def report_cells(spark, d):
    """The filled cells of a report on multiple imputation, with truth and spread between the runs."""
    report = analyse(document_sizes(spark, d), "doc_id", "multiple", missing={
        "mechanism": "MCAR", "rate": 0.3, "target": "n_words"}, seed=SEED)
    return report.cells(limit=None).select("doc_id", "column", *[rounded(n, 3).alias(n) for n in ("value", "truth", "sd")])


@query
def report_notes(spark, d):
    """Focus column and notes of a report on a table that has gaps of its own, in numbers and in text."""
    report = analyse(gappy_events(spark, d), "event_id", "mean", missing={"mechanism": "MCAR", "rate": 0.3, "target": "k"})
    return spark.createDataFrame([("focus", report.column), *[("note", n) for n in report.notes]], "part string, text string")


@query
def full_report(spark, d):
    report = analyse(orders(spark, d), "o_orderkey", "mean", missing={
        "mechanism": "MNAR", "rate": 0.3, "target": "o_totalprice"}, seed=SEED)
    stats = report.stats()
    keep = [f"{side}_{s}" for side in ("before", "after", "truth") for s in ("mean", "std", "min", "max")]
    return stats.select("column", "missing", "before_n", "after_n", "truth_n",
                        *[rounded(s, 4).alias(s) for s in (*keep, "rmse", "deviation_pct")])
