"""Removing values from the orders and line items: how many, which, and with what independence."""

import numpy as np
import pytest
from tests.helpers import collect
from pyspark.sql import functions as F

from gapwise import EngineError, impute, inject_missing, mask_where, resolve_missing
from gapwise.functions.draws import hash_normal, hash_uniform
from gapwise.operators.inject import calibrate_intercept

KEY = "o_orderkey"


def test_shares_and_untouched_cells(orders):
    n = orders.count()
    for mechanism, rate in (("MCAR", 0.2), ("MAR", 0.35), ("MNAR", 0.5)):
        out = collect(inject_missing(orders, KEY, "o_totalprice", mechanism, rate, "o_custkey", 21), KEY)
        spread = (rate * (1 - rate) / n) ** 0.5
        assert abs(out["__mask"].mean() - rate) < 4 * spread
        assert (out["o_totalprice"].isna() == out["__mask"]).all() and out["o_custkey"].notna().all()
        kept = out[~out["__mask"]]
        assert (kept["o_totalprice"] == kept["__truth_o_totalprice"]).all()


def test_who_is_hit(orders):
    mean = {}
    for mechanism in ("MCAR", "MAR", "MNAR"):
        out = collect(inject_missing(orders, KEY, "o_totalprice", mechanism, 0.3, "o_custkey", 5), KEY)
        z = (out[["o_custkey", "__truth_o_totalprice"]] - out[["o_custkey", "__truth_o_totalprice"]].mean()) / out[["o_custkey", "__truth_o_totalprice"]].std()
        mean[mechanism] = z[out["__mask"]].mean()
    assert mean["MAR"]["o_custkey"] > 0.6 and mean["MNAR"]["__truth_o_totalprice"] > 0.6
    for mechanism, name in (("MCAR", "o_custkey"), ("MCAR", "__truth_o_totalprice"), ("MAR", "__truth_o_totalprice"), ("MNAR", "o_custkey")):
        assert abs(mean[mechanism][name]) < 0.2


def test_intercept_meets_the_rate_on_odd_shapes(spark):
    rng = np.random.default_rng(12)
    z = np.r_[rng.gumbel(size=700), np.zeros(200), rng.uniform(3, 6, 100)]
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    for rate in (0.03, 0.42, 0.96):
        chance = 1 / (1 + np.exp(-(calibrate_intercept(df, F.col("z"), rate) + 2.5 * z)))
        assert abs(chance.mean() - rate) < 1e-8


def test_mask_depends_on_key_and_seed_only(orders):
    def hit(df, seed):
        out = inject_missing(df, KEY, "o_totalprice", "MCAR", 0.3, seed=seed)
        return {r[0] for r in out.where("__mask").select(KEY).collect()}

    assert hit(orders.repartition(9), 2) == hit(orders.coalesce(1), 2) != hit(orders, 3)


@pytest.mark.parametrize("mechanism", ["MCAR", "MNAR"])
def test_noise_knows_nothing_of_the_mask(spark, mechanism):
    """One seed for both: what stochastic regression adds has the spread and mean of the residuals among the removed rows."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=30_000)
    df = spark.createDataFrame([(i, float(a), float(3 * a + e)) for i, (a, e) in enumerate(zip(x, rng.normal(size=30_000)))], "id long, a double, b double")
    gaps = inject_missing(df, "id", "b", mechanism, 0.3, seed=4)
    out = {s: collect(impute(gaps, "regression", {"stochastic": s}, 4, "id").frame) for s in (False, True)}
    noise = (out[True]["b"] - out[False]["b"])[out[True]["__mask"]]
    known = out[False][~out[False]["__mask"]]
    slope, level = np.polyfit(known["a"], known["b"], 1)
    residual = (known["b"] - slope * known["a"] - level).std()
    assert abs(noise.std() / residual - 1) < 0.05 and abs(noise.mean()) < 0.05 * residual


def test_refusals(orders):
    good = {"target": "o_totalprice", "mechanism": "MAR", "rate": 0.3, "driver": "o_custkey"}
    for change, code in (({"mechanism": "by hand"}, "bad_mechanism"), ({"rate": 0}, "bad_rate"), ({"rate": None}, "bad_rate"),
                         ({"target": "o_comment"}, "bad_target"), ({"driver": "o_totalprice"}, "bad_driver"), ({"driver": None}, "bad_driver")):
        with pytest.raises(EngineError) as caught:
            inject_missing(orders, KEY, **{**good, **change})
        assert caught.value.code == code
    for gap in (F.lit(None).cast("double"), F.lit(float("nan"))):
        holed = orders.withColumn("o_totalprice", F.when(F.col(KEY) % 50 == 1, gap).otherwise(F.col("o_totalprice")))
        with pytest.raises(EngineError) as caught:
            inject_missing(holed, KEY, "o_custkey")
        assert caught.value.code == "not_complete"


def test_the_least_likely_value_is_spared(orders):
    out = collect(inject_missing(orders, KEY, "o_totalprice", "MNAR", 1 - 1e-12), KEY)
    left = out[out["o_totalprice"].notna()]
    assert len(left) == 1 and left["o_totalprice"].iloc[0] == out["__truth_o_totalprice"].min()


def test_defaults_follow_the_data(lines):
    assert resolve_missing(lines, "line", target="net")["driver"] == "charge"
    spec = resolve_missing(lines.select("line", "qty", "price"), "line", driver="nothing")
    assert (spec["target"], spec["driver"], spec["rate"]) == ("price", "qty", 0.3)
    assert resolve_missing(lines.select("line", "qty"), "line")["driver"] is None


def test_rules_and_draws(spark, orders):
    ruled = mask_where(orders, "o_totalprice", F.col("o_custkey") < 20)
    assert ruled.where("o_totalprice IS NULL").count() == orders.where("o_custkey < 20").count()
    drawn = spark.range(30_000).select(hash_uniform(["id"], "p", 3).alias("u"), hash_normal(["id"], "p", 3).alias("g"), hash_normal(["id"], "q", 3).alias("h")).toPandas()
    assert np.allclose(np.quantile(drawn["u"], [0.1, 0.5, 0.9]), [0.1, 0.5, 0.9], atol=0.012)
    assert np.allclose(drawn[["g", "h"]].std(), 1, atol=0.02) and abs(drawn["g"].corr(drawn["h"])) < 0.02
