"""Pattern-level fits against row-level numpy, and neighbour search against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.helpers import collect, to_spark

from gapwise import impute
from gapwise.functions.missing import profile
from gapwise.operators import knn
from gapwise.operators.cells import Boxes, cut_sample, merged, nearby, nearest, reachable, reachable_within, squared_distances
from gapwise.operators.chained import fit_chained
from gapwise.operators.em import fit_em
from gapwise.operators.linear import bayesian_ridge, least_squares
from gapwise.operators.moments import pattern_stats
from gapwise.operators.refine import refine, unit_counts
from gapwise.operators.regression import fit_regression


def gappy(n, p, share, seed=0, decimals=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + rng.normal(size=p) * 5
    if decimals is not None:
        x = np.round(x, decimals)
    x[rng.random((n, p)) < share] = np.nan
    return pd.DataFrame({"id": np.arange(n), **{f"c{j}": x[:, j] for j in range(p)}})


def bayes_rows(x, y):
    """Row-level Bayesian ridge, straight from the update formulas."""
    n, xm, ym = len(y), x.mean(0), y.mean()
    xc, yc = x - xm, y - ym
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    eig = np.linalg.eigvalsh(xc.T @ xc)
    for _ in range(300):
        w = np.linalg.solve(xc.T @ xc + lam / alpha * np.eye(x.shape[1]), xc.T @ yc)
        gamma = (alpha * eig / (lam + alpha * eig)).sum()
        lam = (gamma + 2e-6) / (w @ w + 2e-6)
        alpha = (n - gamma + 2e-6) / (((yc - xc @ w) ** 2).sum() + 2e-6)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    w = np.linalg.solve(xc.T @ xc + lam / alpha * np.eye(x.shape[1]), xc.T @ yc)
    return ym - w @ xm, w


def chain_rows(x, rounds):
    miss = np.isnan(x)
    f = np.where(miss, np.nanmean(x, axis=0), x)
    limit = 1e-3 * np.nanmax(np.abs(x))
    for _ in range(rounds):
        last = f.copy()
        for j in np.argsort(miss.sum(0), kind="stable"):
            if miss[:, j].any():
                o = [k for k in range(x.shape[1]) if k != j]
                b0, w = bayes_rows(f[~miss[:, j]][:, o], x[~miss[:, j], j])
                f[miss[:, j], j] = b0 + f[miss[:, j]][:, o] @ w
        if np.abs(f - last).sum(1).max() < limit:
            break
    return f


def em_rows(x, rounds):
    n, p = x.shape
    miss = np.isnan(x)
    mu = np.nanmean(x, axis=0)
    f = np.where(miss, mu, x)
    sigma = np.cov(f, rowvar=False, bias=True) + 1e-8 * np.eye(p)
    for it in range(1, rounds + 1):
        f, extra = x.copy(), np.zeros((p, p))
        for i in range(n):
            m, o = miss[i], ~miss[i]
            if m.any():
                b = sigma[np.ix_(m, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)]) if o.any() else np.zeros((m.sum(), 0))
                f[i, m] = mu[m] + b @ (x[i, o] - mu[o])
                extra[np.ix_(m, m)] += sigma[np.ix_(m, m)] - b @ sigma[np.ix_(o, m)]
        mu2 = f.mean(0)
        s2 = ((f - mu2).T @ (f - mu2) + extra) / n
        change = max(np.abs(mu2 - mu).max(), np.abs(s2 - sigma).max()) / max(1.0, np.abs(sigma).max())
        mu, sigma = mu2, s2
        if change < 1e-6:
            return f, mu, sigma, it
    return f, mu, sigma, rounds + 1


@pytest.fixture(scope="module")
def narrow(spark):
    pdf = gappy(600, 4, 0.25)
    pdf.loc[0, ["c0", "c1", "c2", "c3"]] = np.nan
    return pdf, to_spark(spark, pdf).cache()


COLS = ["c0", "c1", "c2", "c3"]


def bounds(kind):
    return {"driver": {}, "distributed": {"max_patterns": 3}}[kind]


@pytest.mark.parametrize("kind", ["driver", "distributed"])
def test_em_equals_row_level(narrow, kind):
    pdf, df = narrow
    seen = profile(df, COLS, COLS)
    stats = pattern_stats(df, COLS, seen, **bounds(kind))
    assert stats.on_driver == (kind == "driver")
    rounds = 200 if kind == "driver" else 4
    got = fit_em(df, COLS, seen, rounds, stats)
    f, mu, sigma, it = em_rows(pdf[COLS].to_numpy(), rounds)
    assert got.iterations == it
    assert np.allclose(got.mu, mu, atol=1e-9) and np.allclose(got.sigma, sigma, atol=1e-9)
    for seen_only in (True, False):
        assert np.allclose(collect(got.fill.transform(df, seen_only))[COLS], f, atol=1e-9)


@pytest.mark.parametrize("kind", ["driver", "distributed"])
def test_chain_equals_row_level(narrow, kind):
    pdf, df = narrow
    seen = profile(df, COLS, COLS)
    rounds = 10 if kind == "driver" else 2
    fill = fit_chained(df, COLS, seen, rounds, pattern_stats(df, COLS, seen, **bounds(kind)))
    assert np.allclose(collect(fill.transform(df, True))[COLS], chain_rows(pdf[COLS].to_numpy(), rounds), atol=1e-6)


def test_wide_tables_take_the_array_path(spark):
    pdf = gappy(400, 14, 0.02)
    cols = [f"c{j}" for j in range(14)]
    df = to_spark(spark, pdf)
    seen = profile(df, cols, cols)
    stats = pattern_stats(df, cols, seen)
    assert stats.on_driver and len(stats.masks) > 10
    x = pdf[cols].to_numpy() - stats.shift
    z = np.column_stack([np.ones(len(x)), np.nan_to_num(x)])
    assert np.allclose(stats.q.sum(axis=0), z.T @ z)
    got = fit_em(df, cols, seen, 20, stats)
    f, mu, sigma, it = em_rows(pdf[cols].to_numpy(), 20)
    assert got.iterations == it and np.allclose(collect(got.fill.transform(df, True))[cols], f, atol=1e-8)
    fill = fit_chained(df, cols, seen, 4, stats)
    assert np.allclose(collect(fill.transform(df, True))[cols], chain_rows(pdf[cols].to_numpy(), 4), atol=1e-6)
    corr = pdf[cols].corr(min_periods=2)
    got = {(r["col_a"], r["col_b"]): r["value"] for r in impute(df, "pairwise", key="id").extras["corr_pairwise"].collect()}
    assert len(got) == 196 and all(abs(got[a, b] - corr.loc[a, b]) < 1e-9 for a in cols for b in cols)


def test_regression_equals_row_level(narrow):
    pdf, df = narrow
    seen = profile(df, COLS, COLS)
    x = pdf[COLS].to_numpy()
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    want = x.copy()
    for j in range(4):
        o, hole = [k for k in range(4) if k != j], np.isnan(x[:, j])
        a = np.column_stack([np.ones(len(x)), filled[:, o]])
        b = np.linalg.lstsq(a[~hole], x[~hole, j], rcond=None)[0]
        want[hole, j] = a[hole] @ b
    model = fit_regression(df, COLS, seen)
    assert np.allclose(collect(model.transform(df))[COLS], want, atol=1e-8)
    noisy = collect(fit_regression(df, COLS, seen, True, ["id"], 5).transform(df))[COLS].to_numpy()
    off = (noisy - want)[np.isnan(x[:, 0]), 0]
    assert 0.7 < off.std() / model.fits["c0"].residual_sd < 1.3


def test_moment_fits_on_collinear_columns():
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    z = np.column_stack([np.ones(500), a, 2 * a, 3 * a + rng.normal(size=500) * 0.1])
    m = z.T @ z
    assert np.allclose(z @ least_squares(m, 3).coef, z[:, :3] @ np.linalg.lstsq(z[:, :3], z[:, 3], rcond=None)[0])
    b0, w = bayes_rows(z[:, 1:3], z[:, 3])
    assert np.allclose(z @ bayesian_ridge(m, 3).coef, b0 + z[:, 1:3] @ w, atol=1e-6)


def brute_knn(pdf, cols, k, weights, scale):
    x = pdf[cols].to_numpy(dtype=float)
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    sd = np.where(sd == 0, 1.0, sd) if scale else np.ones(len(cols))
    z, out = (x - mean) / sd, x.copy()
    for t in range(len(cols)):
        o = [j for j in range(len(cols)) if j != t]
        rows, donors = np.flatnonzero(np.isnan(x[:, t])), np.flatnonzero(~np.isnan(x[:, t]))
        d = squared_distances(z[rows][:, o], z[donors][:, o], len(cols))
        for i, r in enumerate(rows):
            order = np.lexsort((donors, np.round(d[i], 9)))[:k]
            order = order[np.isfinite(d[i, order])]
            if not len(order):
                out[r, t] = mean[t]
                continue
            v, e = x[donors[order], t], np.sqrt(d[i, order])
            if weights == "uniform":
                out[r, t] = v.mean()
            else:
                out[r, t] = v[e == 0].mean() if (e == 0).any() else (v / e).sum() / (1 / e).sum()
    return out


@pytest.mark.parametrize("decimals,share,weights,scale,task_rows", [
    (None, 0.2, "uniform", True, 200_000), (0, 0.3, "distance", True, 200_000), (0, 0.5, "uniform", False, 40),
    (None, 0.1, "distance", False, 25)])
def test_knn_equals_brute_force(spark, monkeypatch, decimals, share, weights, scale, task_rows):
    monkeypatch.setattr(knn, "BOX_ROWS", 8)
    monkeypatch.setattr(knn, "CELL_ROWS", 30)
    monkeypatch.setattr(knn, "MAX_PATTERNS", 3)  # the fourth pattern has to share mixed boxes
    monkeypatch.setattr(knn, "TASK_ROWS", task_rows)
    pdf = gappy(500, 3, share, seed=7, decimals=decimals)
    pdf.loc[200:330, ["c0", "c1"]] = [1.0, 2.0]  # a hot group of copies
    cols = ["c0", "c1", "c2"]
    out = impute(to_spark(spark, pdf), "knn", {"n_neighbors": 4, "weights": weights, "scale": scale}, key="id").frame
    assert np.allclose(collect(out)[cols], brute_knn(pdf, cols, 4, weights, scale), atol=1e-9)


@pytest.mark.parametrize("task_rows", [200_000, 20])
def test_receivers_of_one_vector_are_searched_for_once(spark, monkeypatch, task_rows):
    """Also where a vector has more receivers than a task takes, and where it has gaps."""
    monkeypatch.setattr(knn, "TASK_ROWS", task_rows)
    searched, search = [], knn.nearest_donors

    def counted(receivers, count, *rest):
        searched.append((receivers.count(), count))
        return search(receivers, count, *rest)

    monkeypatch.setattr(knn, "nearest_donors", counted)
    pdf = gappy(300, 3, 0.25, seed=3, decimals=0)
    pdf.loc[100:220, ["c0", "c1"]] = [1.0, np.nan]
    cols = ["c0", "c1", "c2"]
    out = impute(to_spark(spark, pdf), "knn", {"n_neighbors": 3}, key="id").frame
    assert np.allclose(collect(out)[cols], brute_knn(pdf, cols, 3, "uniform", True), atol=1e-9)
    want = [len(pdf[pdf[t].isna()].drop_duplicates([c for c in cols if c != t])) for t in cols]
    assert searched == [(n, n) for n in want] and sum(want) < pdf[cols].isna().sum().sum() - 100


@pytest.mark.parametrize("seed,decimals", [(1, None), (2, 0), (3, 1)])
def test_nearest_equals_all_distances(seed, decimals):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(n, 3)) if decimals is None else rng.normal(size=(n, 3)).round(decimals) for n in (700, 900)]
    for part in x:
        part[rng.random(part.shape) < 0.2] = np.nan
    d = squared_distances(*x, 4)
    reach = np.sort(d, axis=1)[:, 6]  # a bound beyond the fifth
    for bound in (None, reach):
        at, d2 = nearest(*x, 5, 4, bound)
        for i in range(len(d)):
            order = np.lexsort((np.arange(d.shape[1]), np.round(d[i], 9)))[:5]
            order = order[np.isfinite(d[i, order])]
            assert at[i, : len(order)].tolist() == order.tolist() and (at[i, len(order):] == -1).all()
            assert np.array_equal(d2[i, : len(order)], d[i, order])


def test_nearest_of_donors_that_queries_see_at_one_point():
    """Queries without the coordinate that tells donors apart; the smallest positions win, and donors of one pattern have gaps."""
    rng = np.random.default_rng(5)
    donors = np.column_stack([rng.integers(0, 3, 4000), rng.normal(size=4000), np.full(4000, np.nan)])
    queries = np.column_stack([rng.integers(0, 3, 300), rng.normal(size=300), rng.normal(size=300)])
    queries[:200, 1] = np.nan
    at, d2 = nearest(queries, donors, 4, 3)
    d = squared_distances(queries, donors, 3)
    want = np.stack([np.lexsort((np.arange(4000), np.round(row, 9)))[:4] for row in d])
    assert np.array_equal(at, want) and np.array_equal(d2, np.take_along_axis(d, want, axis=1))


def test_receivers_visit_few_cells_and_none_that_matters_is_left_out():
    """With the bound that the donors of the own cell give; the boxes alone gave several cells a row."""
    rng = np.random.default_rng(6)
    donors, q, k = rng.random((64_000, 3)), rng.random((1500, 3)), 5
    tree = cut_sample(donors[:20_000], 9)
    leaf, home = tree.leaf(donors), tree.leaf(q) >> 4
    low, high = (np.stack([how(donors[leaf == i], axis=0) for i in range(512)]) for how in (np.min, np.max))
    count, of_box = np.bincount(leaf, minlength=512), np.arange(512) >> 4
    boxes = Boxes(low, high, np.ones((512, 3), bool), np.ones(512, bool), count)
    cells = merged(boxes, of_box)
    kth = np.full(len(q), np.inf)
    for cell in range(32):
        kth[home == cell] = nearest(q[home == cell], donors[leaf >> 4 == cell], k, 4)[1][:, k - 1]
    kth[:20] = np.inf  # as if the own cell had too few donors: the boxes must do
    at, cell, bound = reachable_within(q, kth, cells, boxes, of_box, k, 4)
    met = set(zip(at.tolist(), cell.tolist()))
    best, d2 = nearest(q, donors, k, 4)
    assert all((i, of_box[leaf[j]]) in met for i in range(len(q)) for j in best[i])
    assert len(met) == len(at) and (bound >= d2[:, k - 1]).all()
    few = np.bincount(at, minlength=len(q))[20:]
    old = reachable(q, boxes, k, 4, [nearby(q)])
    assert few.mean() < 1.7 and 2 * few.mean() < len(np.unique(np.column_stack([old[0], of_box[old[1]]]), axis=0)) / len(q)


def test_neighbours_work_out_their_input_once(spark):
    """A profile and one copy, however many columns have gaps: what makes the rows (here counted) may be dear."""
    pdf, made = gappy(200, 3, 0.2, seed=9), spark.sparkContext.accumulator(0)

    def count(value: float) -> float:
        made.add(1)
        return value

    df = to_spark(spark, pdf).withColumn("c1", F.udf(count, "double")("c1"))
    out = impute(df, "knn", {"n_neighbors": 3}, key="id").frame
    cols = ["c0", "c1", "c2"]
    assert np.allclose(collect(out)[cols], brute_knn(pdf, cols, 3, "uniform", True), atol=1e-9)
    assert made.value <= 2 * len(pdf)


def crowd(spark, n, spot):
    """One cell with ``n`` donors and ``n`` visitors; a third of both lies in a small spot."""
    rng = np.random.default_rng(n)
    at = lambda: np.where(rng.random((n, 1)) < 1 / 3, rng.normal(0, spot, (n, 2)), rng.normal(0, 1, (n, 2)))
    donors = pd.DataFrame(at(), columns=["x0", "x1"]).assign(cell=0, sub="", mixed=False, v=rng.random(n), k0=np.arange(n))
    visits = pd.DataFrame(at(), columns=["x0", "x1"]).assign(cell=0, sub="", row=np.arange(n), bound=np.inf)
    return spark.createDataFrame(donors), spark.createDataFrame(visits)


def test_crowded_cells_give_copies_in_proportion(spark):
    """Donors meet all visitors that need them, units stay small, twice the rows give about twice the visits, and donors
    are copied no more often than they are visited (a unit's donors go once to every hundred of its visitors)."""
    sent = {}
    for n in (1500, 3000, 6000):
        held = []
        donors, visits = refine(*crowd(spark, n, 1e-3), ["x0", "x1"], ["k0"], 3, 2, 100, held)
        units = unit_counts(donors, visits).toPandas()
        assert units["n"].max() <= 100 and units["n"].sum() == n  # every donor lies in one unit
        sent[n] = units["m"].sum()
        assert (units["n"] * np.ceil(units["m"] / 100).clip(lower=1)).sum() <= sent[n] + n
        d, v = donors.toPandas(), visits.toPandas()
        assert not v.duplicated(["row", "cell", "sub"]).any()
        q = v.drop_duplicates("row").set_index("row").sort_index()
        gap = ((q[["x0", "x1"]].to_numpy()[:, None] - d[["x0", "x1"]].to_numpy()[None]) ** 2).sum(axis=2)
        near = np.argsort(gap, axis=1)[:, :3]
        met = set(zip(v["row"], v["sub"]))
        assert len(q) == n and all((row, d["sub"].iloc[i]) in met for row, at in zip(q.index, near) for i in at)
        for copy in held:
            copy.drop()
    assert sent[3000] < 2.4 * sent[1500] and sent[6000] < 2.4 * sent[3000]


def test_units_that_no_cut_divides_are_left_to_shares(spark):
    donors, visits = crowd(spark, 300, 1e-3)
    same = donors.withColumns({n: F.lit(1.0) for n in ("x0", "x1")})
    left, sent = refine(same, visits, ["x0", "x1"], ["k0"], 3, 2, 50, [])
    assert left.count() == 300 and sent.select("row").distinct().count() == 300 and left.select("sub").distinct().count() == 1


def test_knn_with_more_neighbours_than_donors(spark):
    pdf = gappy(30, 2, 0.0)
    pdf.loc[3:, "c1"] = np.nan
    pdf.loc[10, "c0"] = np.nan
    out = collect(impute(to_spark(spark, pdf), "knn", {"n_neighbors": 50}, key="id").frame)
    assert np.allclose(out["c1"], pdf["c1"].fillna(pdf["c1"].mean()))
    assert out["c0"].notna().all()
