import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larkspur.operators import evaluate as ev
from larkspur.operators import models as md
from larkspur.operators.bootstrap import poisson1_cdf, poisson_steps


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(200000, 50000, 500)
    p = y + rng.normal(0, 20000, 500)
    df = spark.createDataFrame(pd.DataFrame({"actual": y, "predicted": p}))
    r = ev.regression_metrics(df, n_features=3, rounded=False).first()
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(r["r2_score"], r2, rel_tol=1e-9)
    assert math.isclose(r["adj_r2"], 1 - (1 - r2) * 499 / 496, rel_tol=1e-9)
    assert math.isclose(r["rmse"], math.sqrt(((y - p) ** 2).mean()), rel_tol=1e-9)
    assert math.isclose(r["mae"], np.abs(y - p).mean(), rel_tol=1e-9)
    assert math.isclose(r["mape"], (np.abs(y - p) / np.abs(y)).mean() * 100, rel_tol=1e-9)


def test_r2_constant_truth_and_gate(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "actual double, predicted double")
    assert ev.regression_metrics(df).first()["r2_score"] == 1.0
    df2 = spark.createDataFrame([(5.0, 4.0), (5.0, 5.0)], "actual double, predicted double")
    m = ev.metric_gate(ev.regression_metrics(df2)).first()
    assert m["r2_score"] == 0.0 and m["r2_gate"] == "FAIL"


def test_prediction_postprocessing(spark):
    df = spark.createDataFrame([(-5.555,), (1234.565,), (0.125,)], "p double")
    single = [r[0] for r in ev.clip_round_prediction(df, "p", "single").collect()]
    assert single[0] == 0.0 and single[2] == 0.12          # clamp, half-even
    band = ev.price_band(spark.createDataFrame([(1000.0,)], "predicted double")).first()
    assert band["price_formatted"] == "$1,000.00" and band["price_range"]["low_text"] == "$900.00"
    assert band["confidence"] == "±10%"


def test_qq_points_filliben(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"actual": r, "predicted": np.zeros(300)}))
    q = ev.qq_points(df).orderBy("rank").collect()
    assert len(q) == 300
    assert np.allclose([x["ordered"] for x in q], np.sort(r))
    # Filliben median position for the middle rank
    mid = q[150]
    pos = (151 - 0.3175) / (300 + 0.365)
    from statistics import NormalDist
    assert math.isclose(mid["theoretical"], NormalDist().inv_cdf(pos), abs_tol=1e-8)


def test_poisson_thresholds():
    cdf = poisson1_cdf(20)
    steps = [int(s, 16) / 16 ** 8 for s in poisson_steps()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(steps, cdf)) and 1.0 - steps[-1] < 1e-8
    assert math.isclose(cdf[0], math.exp(-1)) and cdf[-1] <= 1.0 + 1e-12


def _xy(spark, n=200, seed=42):
    rng = np.random.default_rng(seed)
    f1 = rng.uniform(0, 1000, n)
    f2 = rng.integers(1, 10, n).astype(float)
    f3 = rng.uniform(0, 500, n)
    y = 100 * f1 + 5000 * f2 + 50 * f3 + rng.normal(0, 5000, n)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "f1": f1, "f2": f2, "f3": f3, "label": y})), \
        np.c_[f1, f2, f3], y


def test_ols_and_ridge_closed_form(spark):
    df, X, y = _xy(spark)
    m = md.make_pipeline("linear_regression", ["f1", "f2", "f3"]).fit(df)
    coef, icpt = md.linear_coefficients(m)
    A = np.c_[np.ones(len(y)), X]
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose([icpt] + coef, ref, rtol=1e-6)
    n, s = md.label_stats(df, "label")
    r = md.make_pipeline("ridge", ["f1", "f2", "f3"], n_rows=n, label_std=s, alpha=1.0).fit(df)
    rc, ri = md.linear_coefficients(r)
    Xc, yc = X - X.mean(0), y - y.mean()
    ref_r = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(3), Xc.T @ yc)
    assert np.allclose(rc, ref_r, rtol=1e-4)


def test_select_best_first_wins_ties(spark):
    res = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.95), ("c", 3, 0.95)], "model string, ordinal int, test_r2 double")
    assert md.select_best(res).first()["model"] == "b"


def test_train_save_load_importance(spark, tmp_path):
    df, _, _ = _xy(spark)
    from larkspur.operators.split import assign_split
    s = assign_split(df)
    res, fitted = md.train_models(s.filter("split='train'"), s.filter("split='test'"), ["f1", "f2", "f3"],
                                  names=("linear_regression", "decision_tree"))
    rows = {r["model"]: r for r in res.collect()}
    assert set(rows) == {"linear_regression", "decision_tree"}
    assert all(-1 <= r["test_r2"] <= 1 and r["test_rmse"] >= 0 for r in rows.values())
    path = str(tmp_path / "m")
    md.save_model(fitted["linear_regression"], path)
    again = md.load_model(path)
    a = fitted["linear_regression"].transform(df).select("prediction").collect()
    b = again.transform(df).select("prediction").collect()
    assert a == b
    assert md.feature_importance(fitted["linear_regression"], ["f1", "f2", "f3"], spark=spark).count() == 0
    imp = md.feature_importance(fitted["decision_tree"], ["f1", "f2", "f3"], spark=spark).collect()
    assert imp[0]["rank"] == 1 and imp[0]["importance"] >= imp[-1]["importance"]
    import pytest
    with pytest.raises(FileNotFoundError):
        md.load_model(str(tmp_path / "absent"))


def test_bootstrap_draws_once_per_row_and_replicate(spark):
    """The whole 60 bits of a digest of its own for every row and replicate."""
    import hashlib
    from larkspur.operators.bootstrap import bootstrap_metrics
    n, replicates = 40, 12
    y, p = [100.0 + 7 * i for i in range(n)], [90.0 + 8 * i - i % 5 for i in range(n)]
    df = spark.createDataFrame(list(zip(range(n), y, p)), "id long, actual double, predicted double")
    cdf = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(20)]
    means = []
    for b in range(1, replicates + 1):
        draws = [(int(hashlib.md5(f"7/{b}:{i}".encode()).hexdigest()[:15], 16) + 0.5) / 16 ** 15 for i in range(n)]
        w = [sum(u >= c for c in cdf) for u in draws]
        means.append(sum(a * (c - d) for a, c, d in zip(w, y, p)) / sum(w))
    row = bootstrap_metrics(df, replicates=replicates).where("metric = 'mean_residual'").first()
    assert np.allclose([row["lo"], row["hi"]], np.quantile(means, [0.05, 0.95]))


def test_hash_steps_are_those_of_the_numeric_rule():
    from larkspur.operators.bootstrap import hash_steps
    place = lambda h: (float(h) + 0.5) / float(16 ** 15)
    for step, p in zip(hash_steps(), poisson1_cdf()):
        assert len(step) == 15 and place(int(step, 16)) >= p > place(int(step, 16) - 1)


def test_tree_settings_bound_the_memory_of_a_task():
    for name in ("decision_tree", "random_forest", "gradient_boosting", "xgboost"):
        est = md.make_estimator(name)
        assert est.getMaxMemoryInMB() <= 256 and est.getCacheNodeIds() == (name != "random_forest")


def test_pipelines_of_trees_keep_no_node_ids(spark):
    from pyspark.sql import functions as F
    for name in md.TREES:
        est = md.make_pipeline(name, ["x"]).getStages()[-1]
        assert not est.getCacheNodeIds() and est.getMaxMemoryInMB() <= 256
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("z"),
                                 (F.col("id") * F.col("id") % 97).cast("double").alias("label")).repartition(3, "x").cache()
    for name, kw in (("decision_tree", {}), ("gradient_boosting", {"maxIter": 5})):
        now, kept = (md.make_pipeline(name, ["x", "z"], **kw, **k).fit(df).stages[-1] for k in ({}, {"cacheNodeIds": True}))
        assert now.toDebugString.split("\n")[1:] == kept.toDebugString.split("\n")[1:]
    df.unpersist()


def test_fits_of_many_rows_run_one_at_a_time(spark, monkeypatch):
    import threading
    from pyspark.sql import functions as F
    assert md.fits_at_once(48_000, 100) == 4 and md.fits_at_once(29_000_000, 13) == 1 and md.fits_at_once(0, 1, 1) == 1
    df = spark.range(200).select("id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("label"))
    lock, running, most, made = threading.Lock(), [0], [0], md.make_pipeline

    def watched(*args, **kw):
        pipe = made(*args, **kw)

        class Watched:
            def fit(self, rows):
                with lock:
                    running[0] += 1
                    most[0] = max(most[0], running[0])
                model = pipe.fit(rows)
                with lock:
                    running[0] -= 1
                return model
        return Watched()

    wide = md.cross_validate(df, ["x"], names=("decision_tree",), k=3).collect()
    monkeypatch.setattr(md, "make_pipeline", watched)
    monkeypatch.setattr(md, "POINTS_AT_ONCE", 200 * md.POINT_BYTES)
    narrow = md.cross_validate(df, ["x"], names=("decision_tree",), k=3).collect()
    assert most[0] == 1
    assert sorted(narrow[0]["fold_r2"]) == sorted(wide[0]["fold_r2"])


def test_md5_of_a_block_of_texts():
    import hashlib
    import pyarrow as pa
    from larkspur.functions.md5_blocks import leading_digits
    texts = ["", ":", ":é中", None, *[":" + "x" * k for k in (1, 2, 3, 49, 50, 51, 55, 56, 63, 64, 119, 120, 5000)]]
    prefixes = [b"7/1", b"7/10", b"7/11", b"7/100", b"", b"p" * 70]
    got = {(int(a), i): int(x) for at, i, h in leading_digits(pa.array(["cut", *texts])[1:], prefixes, 15) for a, x in zip(at, h)}
    assert got == {(a, i): int(hashlib.md5(p + (t or "").encode()).hexdigest()[:15], 16)
                   for a, t in enumerate(texts) for i, p in enumerate(prefixes)}


def test_bootstrap_makes_no_row_of_each_draw(spark):
    """No row and replicate is a row of its own, of any key; an empty table has no interval."""
    from larkspur.operators.bootstrap import bootstrap_metrics
    rows = [(None, 9.0, 7.0), ("a" * 60, 5.0, 4.5), ("b", 3.0, 4.0), ("b", 3.0, 4.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "id string, actual double, predicted double")
    out = bootstrap_metrics(df, replicates=3)
    assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    import hashlib
    cdf = poisson1_cdf()
    means = []
    for b in (1, 2, 3):
        w = [sum((int(hashlib.md5((f"7/{b}" + ("" if k is None else f":{k}")).encode()).hexdigest()[:15], 16) + 0.5) / 16 ** 15 >= c
                 for c in cdf) for k, _, _ in rows[:4]]
        means.append(sum(a * (y - p) for a, (_, y, p) in zip(w, rows)) / sum(w))
    got = {r["metric"]: r for r in out.collect()}["mean_residual"]
    assert np.allclose([got["lo"], got["hi"]], np.quantile(means, [0.05, 0.95]))
    assert all(r["lo"] is None for r in bootstrap_metrics(df.where("id = 'none'"), replicates=3).collect())
