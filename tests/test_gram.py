"""The linear family from moments, against refits on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import gram
from larkspur.operators import models as md
from larkspur.operators.quantiles import descent_quantiles, values_at_ranks
from larkspur.operators.split import assign_folds, with_curve_share


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.uniform(1900, 2020, n), rng.integers(1, 10, n).astype(float), rng.uniform(0, 500, n)]
    x = np.c_[x, x[:, 1] + 3]                                     # collinear
    return x, 1e5 + 100 * x[:, 0] + 5000 * x[:, 1] + 50 * x[:, 2] + rng.normal(0, 2000, n)


def refit(x, y, family, alpha):
    """Plain fits: least squares by lstsq, ridge by augmented rows, lasso by its
    stationarity conditions (checked, not solved, below)."""
    xc, yc = x - x.mean(0), y - y.mean()
    if family == "ridge":
        a = np.r_[xc, np.sqrt(alpha) * np.eye(x.shape[1])]
        w = np.linalg.lstsq(a, np.r_[yc, np.zeros(x.shape[1])], rcond=None)[0]
    else:
        w = np.linalg.lstsq(xc, yc, rcond=None)[0]
    return w, y.mean() - w @ x.mean(0)


def r2(x, y, w, w0):
    return 1 - ((y - w0 - x @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("cut", [1, 7, 300, 599])
def test_moments_merge(cut):
    x, y = rows()
    both = np.c_[x, y]
    whole = gram.Moments.of(both)
    parts = gram.Moments.of(both[:cut], 2) + gram.Moments.of(both[cut:], 3) + gram.Moments.of(both[:0])
    assert parts.n == whole.n and parts.skipped == 5
    assert np.allclose(parts.mean, whole.mean) and np.allclose(parts.scatter, whole.scatter)


@pytest.mark.parametrize("family,alpha", [("linear_regression", 0.0), ("ridge", 1.0), ("ridge", 500.0)])
def test_fits_and_scores_equal_refits(family, alpha):
    x, y = rows()
    fit = gram.fit_linear(gram.Moments.of(np.c_[x[:400], y[:400]]), family, alpha)
    w, w0 = refit(x[:400], y[:400], family, alpha)
    held = gram.Moments.of(np.c_[x[400:], y[400:]])
    assert abs(fit.r2(held) - r2(x[400:], y[400:], w, w0)) < 1e-8
    assert abs(fit.rmse(held) - np.sqrt(((y[400:] - w0 - x[400:] @ w) ** 2).mean())) < 1e-4


@pytest.mark.parametrize("alpha", [0.001, 1.0, 50.0, 1e6])
def test_lasso_is_stationary(alpha):
    x, y = rows()
    fit = gram.fit_linear(gram.Moments.of(np.c_[x, y]), "lasso", alpha)
    pull = (x - x.mean(0)).T @ (y - fit.intercept - x @ fit.coefficients) / len(y)
    for g, w in zip(pull, fit.coefficients, strict=True):
        assert abs(g - np.sign(w) * alpha) < 1e-3 if w else abs(g) <= alpha * (1 + 1e-6)


def test_one_scan_equals_refits_on_rows(spark):
    x, y = rows()
    names = ["a", "b", "c", "d"]
    pdf = pd.DataFrame(x, columns=names).assign(label=y, id=range(len(y)))
    df = spark.createDataFrame(pdf)
    df = df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double")).withColumn("id", F.lit(10_000).cast("long")))
    df = df.repartition(5)
    placed = with_curve_share(assign_folds(df, "id", 5)).where("a is not null").toPandas()
    scores = {(r.variant, r.fold): r for r in gram.fold_scores(df, names).collect()}
    assert len(scores) == 15
    for f in range(5):
        tr, te = placed[placed.fold != f], placed[placed.fold == f]
        for name in ("linear_regression", "ridge"):
            w, w0 = refit(tr[names].to_numpy(), tr.label.to_numpy(), name, 1.0)
            got = scores[name, f]
            assert got.n == len(te) and got.n_train == len(tr)
            assert abs(got.r2_score - r2(te[names].to_numpy(), te.label.to_numpy(), w, w0)) < 1e-6
    curve = {(r.fraction, r.fold): r for r in gram.learning_curve(df, names).collect()}
    for (fraction, f), r in curve.items():
        tr, te = placed[(placed.fold != f) & (placed.curve_share < fraction)], placed[placed.fold == f]
        assert r.n_train == len(tr)
        w, w0 = refit(tr[names].to_numpy(), tr.label.to_numpy(), "linear_regression", 0)
        assert abs(r.validation_r2 - r2(te[names].to_numpy(), te.label.to_numpy(), w, w0)) < 1e-6
        assert abs(r.train_r2 - r2(tr[names].to_numpy(), tr.label.to_numpy(), w, w0)) < 1e-6
    assert sum(m.skipped for m in gram.cells(df, names).values()) == 1
    assert gram.moments(df.where("id < 0"), names, by=["id"]).count() == 0


def test_grids(spark):
    x, y = rows(200)
    df = spark.createDataFrame(pd.DataFrame(x[:, :3], columns=["a", "b", "c"]).assign(label=y, id=range(200)))
    model, scores = md.grid_search(df, ["a", "b", "c"], name="ridge", folds=3)
    assert [p["alpha"] for p, _ in scores] == md.GRIDS["ridge"]["regParam"]
    best, fit, again = gram.alpha_grid(df, ["a", "b", "c"], family="ridge", alphas=md.GRIDS["ridge"]["regParam"], seed=md.TUNING_SEED)
    assert [s for _, s in again] == [s for _, s in scores] and best == max(again, key=lambda t: t[1])[0]
    assert np.allclose(md.linear_coefficients(model)[0], fit.coefficients, rtol=1e-4)


def test_staged_boosting_equals_separate_fits(spark):
    x, y = rows(200)
    df = spark.createDataFrame(pd.DataFrame(x[:, :3], columns=["a", "b", "c"]).assign(label=y, id=range(200))).cache()
    from pyspark.ml.evaluation import RegressionEvaluator
    ev = RegressionEvaluator(labelCol="label", metricName="r2")
    long = md.make_pipeline("gradient_boosting", ["a", "b", "c"], maxIter=4).fit(df)
    staged = md.staged_scores(long, df, "label", [2, 4])
    for m in (2, 4):
        alone = md.make_pipeline("gradient_boosting", ["a", "b", "c"], maxIter=m).fit(df)
        assert abs(ev.evaluate(alone.transform(df)) - staged[m]) < 1e-9
    grid = {"maxIter": [2, 3], "maxDepth": [1, 2]}
    best, scores = md.grid_search(df, ["a", "b", "c"], name="gradient_boosting", grid=grid, folds=2)
    assert sorted((p["maxIter"], p["maxDepth"]) for p, _ in scores) == [(2, 1), (2, 2), (3, 1), (3, 2)]
    top = max(scores, key=lambda t: t[1])[0]
    assert best.stages[-1].getNumTrees == top["maxIter"]


def test_values_at_ranks(spark):
    inf = float("inf")
    values = [3.0, -1.5, 3.0, 7.25, 1e300, -1e300, 0.0, 3.0, inf, -inf, 1e-300, 2.0] + [5.0] * 50 + [float(i) for i in range(900)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").cache()
    order = sorted(values)
    ranks = [0, 1, 2, 3, 5, 100, 480, len(order) - 3, len(order) - 2, len(order) - 1]
    assert values_at_ranks(df, "v", ranks) == {r: order[r] for r in ranks}
    finite = [v for v in values if abs(v) < inf]
    got = descent_quantiles(spark.createDataFrame([(v,) for v in finite], "v double"), "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert np.allclose(got, np.quantile(finite, [0, 0.25, 0.5, 0.75, 1]))
    assert descent_quantiles(df.where("v > 1e301 and v < 1e302"), "v", [0.5]) == [None]
