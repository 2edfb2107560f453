"""Queries: models, tuning, persistence, streaming, sources/sinks
(M1-M10, M14, M16-M17, M19-M22, R3, S1, S3-S6, ST1, T10, P17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_sql, mix_key_sql
from ..functions.normal import norm_ppf_sql
from ..operators import features as fe
from ..operators import gram
from ..operators import models as md
from ..sources import files
from ..sources.listing import dirty_listing, listing
from ..sources.tables import cut_lineage
from ..streaming.score_stream import score_stream
from . import linear_sql as ls
from . import training as tr
from .oracle_base import with_dirty_listing, with_listing
from .q_clean import _NUM, _iqr_chain_sql, _round_cols
from .q_eval import _METRICS_SQL
from .registry import register


def _frame(spark, sf):
    return cut_lineage(tr.model_frame(listing(spark, sf)))   # fitted on many times


def _test_predictions(spark, sf, name, features=tr.MODEL_FEATURES):
    d = _frame(spark, sf)
    train = d.filter(F.col("split") == "train")
    test = d.filter(F.col("split") == "test")
    model = md.make_pipeline(name, features, "label", **_lab(train)).fit(train)
    return model.transform(test).select("id", F.round("prediction", 6).alias("prediction"))


def _lab(train):
    n, s = md.label_stats(train, "label")
    return {"n_rows": n, "label_std": s}


@register("ols_single", "M1", with_listing(f"""
SELECT round(regr_slope(CAST(SalePrice AS DOUBLE), CAST(GrLivArea AS DOUBLE)), 6) AS slope,
       round(regr_intercept(CAST(SalePrice AS DOUBLE), CAST(GrLivArea AS DOUBLE)), 4) AS intercept,
       round(regr_r2(CAST(SalePrice AS DOUBLE), CAST(GrLivArea AS DOUBLE)), 6) AS r2
FROM listing WHERE {bucket_sql('id', 10000, 42)} >= 2000"""))
def ols_single(spark, sf):
    d = _frame(spark, sf).filter(F.col("split") == "train")
    m = md.make_pipeline("linear_regression", ["GrLivArea"], "label").fit(d)
    lr = m.stages[-1]
    return spark.createDataFrame(
        [(round(float(lr.coefficients[0]), 6), round(float(lr.intercept), 4), round(float(lr.summary.r2), 6))],
        "slope double, intercept double, r2 double")


@register("ols_multi", "M1")
def ols_multi(spark, sf):
    return _test_predictions(spark, sf, "linear_regression")


@register("ridge_score", "M2")
def ridge_score(spark, sf):
    return _test_predictions(spark, sf, "ridge")


@register("lasso_score", "M3")
def lasso_score(spark, sf):
    return _test_predictions(spark, sf, "lasso")


@register("tree_score", "M4")
def tree_score(spark, sf):
    return _test_predictions(spark, sf, "decision_tree")


@register("forest_score", "M5")
def forest_score(spark, sf):
    return _test_predictions(spark, sf, "random_forest")


@register("gbt_score", "M6")
def gbt_score(spark, sf):
    return _test_predictions(spark, sf, "gradient_boosting")


@register("hist_boost_score", "M7")
def hist_boost_score(spark, sf):
    return _test_predictions(spark, sf, "xgboost")


@register("model_comparison", "M8 M12 M13")
def model_comparison(spark, sf):
    d = _frame(spark, sf)
    res, _ = md.train_models(d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test"),
                             tr.MODEL_FEATURES, "label")
    return md.rank_models(res.drop("train_time"))


@register("cross_validate", "M9 R1")
def cross_validate(spark, sf):
    d = _frame(spark, sf).filter(F.col("split") == "train")
    out = md.cross_validate(d, tr.MODEL_FEATURES, "label", md.MODEL_ORDER, k=5)
    return out.select("model", "ordinal", F.round("cv_mean", 6).alias("cv_mean"),
                      F.round("cv_std", 6).alias("cv_std"))


# ------------------------------------------- linear family from moments, and SQL

_LINEAR = tr.MODEL_FEATURES
_COLLINEAR = "TotRmsAbvGrd"          # BedroomAbvGr + 3 in the listing
_TRAIN = f"{bucket_sql('id', 10000, 42)} >= 2000"
_LINEAR_ROWS = with_listing(f""",
r AS MATERIALIZED (
  SELECT id, CAST(SalePrice AS DOUBLE) AS y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LINEAR)}, {_TRAIN} AS train,
         {bucket_sql('id', 5, 43)} AS fold, {bucket_sql('id', 3, md.TUNING_SEED + 1)} AS tuning,
         least({bucket_sql('id', 10000, 44)} // 1000, 9) AS step
  FROM listing)""").replace("WITH ", "WITH RECURSIVE ", 1)
_BASE_VARIANTS = [(f, f, 1.0) for f in gram.LINEAR_FAMILY]


def _members(tasks: str, condition: str) -> str:
    return f""",
tasks AS ({tasks}),
members AS (SELECT t.task, r.* FROM r JOIN tasks t ON r.train AND {condition}),"""


@register("linear_moments", "M1 R1", with_listing(f""",
r AS (SELECT {bucket_sql('id', 5, 43)}::INTEGER AS fold, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in (*_LINEAR, 'SalePrice'))}
      FROM listing WHERE {_TRAIN})
""" + " UNION ALL ".join(
    f"SELECT fold, '{a}' AS feature, count(*) AS n, round(avg({a}), 6) AS mean, round(var_pop({a}), 4) AS variance, "
    f"round(covar_pop({a}, SalePrice), 2) AS with_label FROM r GROUP BY fold" for a in _LINEAR)))
def linear_moments(spark, sf):
    """Per fold and feature: the moments from which the linear family is fitted."""
    train = split_fold(spark, sf)
    found = gram.moments(train, _LINEAR, "label", ["fold"])
    width = len(_LINEAR) + 1
    at = F.posexplode(F.array(*[F.lit(c) for c in _LINEAR])).alias("i", "feature")
    long = found.select("fold", "n", "mean", "scatter", at)
    return long.select("fold", "feature", F.col("n").cast("long").alias("n"), F.round(F.get("mean", F.col("i")), 6).alias("mean"),
                       F.round(F.get("scatter", F.col("i") * (width + 1)) / F.col("n"), 4).alias("variance"),
                       F.round(F.get("scatter", F.col("i") * width + width - 1) / F.col("n"), 2).alias("with_label"))


def split_fold(spark, sf):
    from ..operators.split import assign_folds
    return assign_folds(tr.model_frame(listing(spark, sf)).where("split = 'train'"))


@register("cross_validate_linear", "M9 R1 M1 M2 M3", _LINEAR_ROWS + _members(
    "SELECT unnest(range(0, 5)) AS task", "r.fold <> t.task") + ls.fits(_LINEAR, _BASE_VARIANTS, _COLLINEAR) + f"""
SELECT variant AS model, task::INTEGER AS fold, n, round(r2, 5) AS r2_score
FROM ({ls.scores('r.train AND r.fold = c.task', 'variant, task', _LINEAR, 'r')})""")
def cross_validate_linear(spark, sf):
    """R2 on each of five folds, all models and folds from one scan."""
    train = tr.model_frame(listing(spark, sf)).where("split = 'train'")
    return gram.fold_scores(train, _LINEAR, "label", k=5).select(
        F.col("variant").alias("model"), "fold", "n", F.round("r2_score", 5).alias("r2_score"))


@register("linear_test_scores", "M1 M2 M3", _LINEAR_ROWS + _members("SELECT 0 AS task", "true")
          + ls.fits(_LINEAR, _BASE_VARIANTS, _COLLINEAR) + f"""
SELECT variant AS model, n, round(r2, 5) AS r2_score, round(rmse, 1) AS rmse
FROM ({ls.scores('NOT r.train', 'variant', _LINEAR, 'r')})""")
def linear_test_scores(spark, sf):
    """Scores of the fitted MLlib models on the test rows; SQL fits for itself."""
    from ..operators.evaluate import regression_metrics
    d = _frame(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    lab = _lab(train)
    scored = [md.make_pipeline(name, _LINEAR, "label", **lab).fit(train).transform(test).select(
        F.lit(name).alias("model"), F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
        for name in gram.LINEAR_FAMILY]
    m = regression_metrics(reduce(DataFrame.unionByName, scored), by=["model"], rounded=False)
    return m.select("model", "n", F.round("r2_score", 5).alias("r2_score"), F.round("rmse", 1).alias("rmse"))


_GRID_VARIANTS = [(f"{f}/{a!r}", f, float(a)) for f in ("ridge", "lasso") for a in md.GRIDS[f]["regParam"]]


@register("grid_search", "M10 R2", _LINEAR_ROWS + _members("SELECT unnest(range(0, 3)) AS task", "r.tuning <> t.task")
          + ls.fits(_LINEAR, _GRID_VARIANTS) + f"""
SELECT split_part(variant, '/', 1) AS model, split_part(variant, '/', 2)::DOUBLE AS alpha, round(avg(r2), 6) AS cv_r2
FROM ({ls.scores('r.train AND r.tuning = c.task', 'variant, task', _LINEAR, 'r')}) GROUP BY variant""")
def grid_search(spark, sf):
    """The whole ridge and lasso grids over three tuning folds."""
    d = tr.model_frame(listing(spark, sf)).filter(F.col("split") == "train")
    rows = [(f, float(a), float(r2)) for f in ("ridge", "lasso") for a, r2 in
            gram.alpha_grid(d, _LINEAR, "label", f, md.GRIDS[f]["regParam"], 3, seed=md.TUNING_SEED)[2]]
    return spark.createDataFrame(rows, "model string, alpha double, cv_r2 double").withColumn("cv_r2", F.round("cv_r2", 6))


@register("tuning_gain", "M19 M10", _LINEAR_ROWS + _members(
    "SELECT unnest(range(0, 4)) AS task", "(t.task = 3 OR r.tuning <> t.task)")
          + ls.fits(_LINEAR, [v for v in _GRID_VARIANTS if v[1] == "lasso"]) + f""",
cv AS (SELECT variant, avg(r2) AS r2 FROM ({ls.scores('c.task < 3 AND r.train AND r.tuning = c.task', 'variant, task', _LINEAR, 'r')}) GROUP BY variant),
test AS ({ls.scores('c.task = 3 AND NOT r.train', 'variant', _LINEAR, 'r')})
SELECT round(t.r2 - b.r2, 6) AS delta_r2, round(t.rmse - b.rmse, 4) AS delta_rmse
FROM test t, test b WHERE b.variant = 'lasso/1.0' AND t.variant = (SELECT arg_max(variant, r2) FROM cv)""")
def tuning_gain(spark, sf):
    """Lasso at its default penalty against the one that tuning chooses."""
    d = _frame(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    _, tuned, _ = gram.alpha_grid(train, _LINEAR, "label", "lasso", md.GRIDS["lasso"]["regParam"], 3, seed=md.TUNING_SEED)
    base = gram.fit_linear(gram.merged(gram.cells(train, _LINEAR, "label").values()), "lasso")
    held = gram.merged(gram.cells(test, _LINEAR, "label").values())
    return spark.createDataFrame([(round(tuned.r2(held) - base.r2(held), 6), round(tuned.rmse(held) - base.rmse(held), 4))],
                                 "delta_r2 double, delta_rmse double")


@register("feature_importance", "M14 M15")
def feature_importance(spark, sf):
    d = _frame(spark, sf).filter(F.col("split") == "train")
    m = md.make_pipeline("decision_tree", tr.MODEL_FEATURES, "label").fit(d)
    return md.feature_importance(m, tr.MODEL_FEATURES, 20, spark)


# without the feature that is another one and a constant: of such a pair, importance is arbitrary
_DISTINCT = tuple(f for f in _LINEAR if f != _COLLINEAR)


@register("permutation_importance", "M20 M1", _LINEAR_ROWS + _members("SELECT 0 AS task", "true")
          + ls.fits(_DISTINCT, [("ols", "linear_regression", 0.0)]) + f""",
placed AS (SELECT r.*, row_number() OVER (ORDER BY {mix_key_sql('id', md.SEED + 1)}, id) AS place,
                  row_number() OVER (ORDER BY {mix_key_sql('id', md.SEED + 2)}, id) AS gives FROM r WHERE NOT train),
p AS (SELECT a.y, c.w0 + {' + '.join(f'c.w[{i}] * a.{f}' for i, f in enumerate(_DISTINCT, 1))} AS p,
             {', '.join(f'c.w[{i}] * (b.{f} - a.{f}) AS d_{f}' for i, f in enumerate(_DISTINCT, 1))}
      FROM placed a JOIN placed b ON a.place = b.gives, coef c),
s AS (SELECT sum((y - p) * (y - p)) AS base, var_pop(y) * count(*) AS total,
             {', '.join(f'sum((y - p - d_{f}) * (y - p - d_{f})) AS s_{f}' for f in _DISTINCT)} FROM p)
""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round((s_{f} - base) / total, 6) AS importance FROM s" for f in _DISTINCT))
def permutation_importance(spark, sf):
    d = _frame(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    m = md.make_pipeline("linear_regression", _DISTINCT, "label").fit(train)
    out = md.permutation_importance(m, test, _DISTINCT, "label", "id")
    return out.withColumn("importance", F.round("importance", 6) + F.lit(0.0))


def _model_dir(spark, name):
    return files.scratch_path(spark, f"model-{name}")


@register("model_reload_score", "S5 S6 M16")
def model_reload_score(spark, sf):
    d = _frame(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    model = tr.scaled_pipeline(train, "ridge")
    path = md.save_model(model, _model_dir(spark, "ridge"))
    again = md.load_model(path)
    a = model.transform(test).select("id", F.col("prediction").alias("p1"))
    b = again.transform(test).select("id", F.col("prediction").alias("p2"))
    return a.join(b, "id").select("id", F.round("p1", 6).alias("prediction"),
                                  (F.abs(F.col("p1") - F.col("p2")) < 1e-9).alias("same"))


@register("batch_score", "M17 P20 P23 A28 S3")
def batch_score(spark, sf):
    d = _frame(spark, sf)
    train = d.filter(F.col("split") == "train")
    model = tr.scaled_pipeline(train, "linear_regression")
    batch = listing(spark, sf).select("id", *tr.MODEL_FEATURES, "Neighborhood")
    out = md.predict_batch(model, batch, "PredictedPrice", sink=files.scratch_path(spark, "batch-csv"))
    return out


@register("sink_roundtrip", "S1 S3", with_dirty_listing("""
SELECT * FROM dirty_listing"""))
def sink_roundtrip(spark, sf):
    """Write the dirty table as CSV with NA for NULL, read it back through
    the NA-aware CSV scan with an explicit schema."""
    d = dirty_listing(spark, sf)
    path = files.write_csv(d, files.scratch_path(spark, "dirty-csv"), null_token="NA")
    return files.read_csv(spark, path, d.schema)


@register("csv_scan_na", "S1", with_dirty_listing("""
SELECT count(*) AS "rows", CAST(count(*) - count(GrLivArea) AS BIGINT) AS null_GrLivArea,
       CAST(count(*) - count(LotArea) AS BIGINT) AS null_LotArea,
       CAST(count(*) - count(MSZoning) AS BIGINT) AS null_MSZoning,
       CAST(count(*) - count(ExterQual) AS BIGINT) AS null_ExterQual FROM dirty_listing"""))
def csv_scan_na(spark, sf):
    back = sink_roundtrip(spark, sf)
    return back.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}")
                      for c in ("GrLivArea", "LotArea", "MSZoning", "ExterQual")])


@register("split_sink_roundtrip", "S4", with_listing(f"""
SELECT CASE WHEN {bucket_sql('id', 10000, 42)} < 2000 THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM listing GROUP BY 1"""))
def split_sink_roundtrip(spark, sf):
    d = _frame(spark, sf)
    path = files.write_split_pair(d, files.scratch_path(spark, "split-pair"))
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("stream_score", "ST1 M16 M17")
def stream_score(spark, sf):
    d = _frame(spark, sf)
    model = tr.scaled_pipeline(d.filter(F.col("split") == "train"), "linear_regression")
    out = files.scratch_path(spark, "stream-out")
    return score_stream(spark, sf, model, out + "/data", out + "/checkpoint")


@register("learning_curve", "R3 M1", _LINEAR_ROWS + _members(
    "SELECT f * 100 + s AS task FROM range(0, 5) a(f), range(1, 11) b(s)", "r.fold <> t.task // 100 AND r.step < t.task % 100")
          + ls.fits(_LINEAR, [("ols", "linear_regression", 0.0)], _COLLINEAR) + f""",
held AS ({ls.scores('r.train AND r.fold = c.task // 100', 'task', _LINEAR, 'r')}),
seen AS ({ls.scores('r.train AND r.fold <> c.task // 100 AND r.step < c.task % 100', 'task', _LINEAR, 'r')})
SELECT (task % 100) / 10.0::DOUBLE AS fraction, count(*) AS folds, round(avg(s.r2), 6) AS train_mean, round(stddev_pop(s.r2), 6) AS train_std,
       round(avg(h.r2), 6) AS validation_mean, round(stddev_pop(h.r2), 6) AS validation_std
FROM held h JOIN seen s USING (task) GROUP BY 1""")
def learning_curve(spark, sf):
    """Ten nested training shares x five folds: mean and spread of R2."""
    train = tr.model_frame(listing(spark, sf)).where("split = 'train'")
    spread = gram.curve_spread(gram.learning_curve(train, _LINEAR, "label"))
    return _round_cols(spread, ["train_mean", "train_std", "validation_mean", "validation_std"])


_REPORTS_SQL = _LINEAR_ROWS + _members("SELECT 0 AS task", "true") + ls.fits(_DISTINCT, _BASE_VARIANTS) + f""",
p AS MATERIALIZED (SELECT c.variant, r.train, r.y AS actual, c.w0 + {' + '.join(f'c.w[{i}] * r.{f}' for i, f in enumerate(_DISTINCT, 1))} AS predicted
      FROM r, coef c),
scored AS MATERIALIZED (SELECT actual, predicted FROM p WHERE variant = 'linear_regression' AND NOT train),
m AS (SELECT {_METRICS_SQL.replace(' - 13 - 1', f' - {len(_DISTINCT)} - 1')} FROM scored),
mm AS (SELECT min(actual) AS lo, max(actual) AS hi FROM scored),
b AS (SELECT least(5, greatest(1, CAST(ceil((actual - lo) / ((hi - lo) / 5.0::DOUBLE)) AS INTEGER))) AS bin, actual, predicted FROM scored, mm),
g AS (SELECT (['Very Low', 'Low', 'Medium', 'High', 'Very High'])[bin] AS range_label, avg(abs(actual - predicted)) AS mae,
             avg(abs(actual - predicted) / abs(actual) * 100) AS mpe, count(*) AS n FROM b GROUP BY bin),
n AS (SELECT count(*) AS n FROM scored),
pts AS (SELECT row_number() OVER (ORDER BY actual - predicted) - 1 AS rank, actual - predicted AS ordered FROM scored),
q AS (SELECT ordered, CASE WHEN rank = 0 THEN 1.0 - pow(0.5, 1.0 / n) WHEN rank = n - 1 THEN pow(0.5, 1.0 / n)
                          ELSE (rank + 1 - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM pts, n),
th AS (SELECT ordered, {norm_ppf_sql('p')} AS theoretical FROM q),
models AS (SELECT variant, train, 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) AS r2, sqrt(avg((actual - predicted) ^ 2)) AS rmse
           FROM p GROUP BY variant, train)
""" + " UNION ALL ".join(
    [f"SELECT 'metrics' AS report, '{c}' AS item, {c}::DOUBLE AS value FROM m" for c in ("n", "r2_score", "adj_r2", "rmse", "mae", "mape", "mse")]
    + [f"SELECT 'residuals', 'residual_{n}', {f}(actual - predicted) FROM scored" for n, f in (("mean", "avg"), ("std", "stddev_samp"))]
    + [f"SELECT 'ranges', range_label || '/{n}', {c}::DOUBLE FROM g" for n, c in (("mean_abs_error", "mae"), ("mean_pct_error", "mpe"), ("count", "n"))]
    + [f"SELECT 'qq', '{n}', {f}(ordered, theoretical) FROM th" for n, f in (("slope", "regr_slope"), ("intercept", "regr_intercept"))]
    + ["SELECT 'comparison', variant || '/test_r2', round(r2, 4) FROM models WHERE NOT train",
       "SELECT 'comparison', variant || '/test_rmse', round(rmse, 2) FROM models WHERE NOT train",
       "SELECT 'comparison', variant || '/train_r2', round(r2, 4) FROM models WHERE train"]
    + [f"SELECT 'correlation', '{c}/corr', corr({c}, y) FROM r" for c in _DISTINCT] + ["SELECT 'correlation', 'label/corr', 1.0::DOUBLE"])


@register("full_evaluation", "M21 A21 A26 A15 A27 M12 A12", 
          f"SELECT report, item, CASE WHEN item LIKE '%/test_rmse' THEN round(value, 0) ELSE round(value, 3) END AS value FROM ({_REPORTS_SQL})")
def full_evaluation(spark, sf):
    """All reports: metrics, residuals, price ranges, Q-Q line, the ranking of
    the linear models and the correlations of the features."""
    d = _frame(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    results, fitted = md.train_models(train, test, _DISTINCT, "label", gram.LINEAR_FAMILY)
    rep = tr.full_evaluation(fitted["linear_regression"], test, "label", len(_DISTINCT), feature_names=_DISTINCT,
                             results=results, df=d.select(*_DISTINCT, "label"))
    value = F.when(F.col("item").endswith("/test_rmse"), F.round("value", 0)).otherwise(F.round("value", 3))
    return tr.report_rows(rep).where("value is not null").withColumn("value", value + F.lit(0.0))


@register("train_end_to_end", "M22 P17 T10")
def train_end_to_end(spark, sf):
    df = listing(spark, sf)
    results, best, _, _ = tr.train_end_to_end(df, model_path=_model_dir(spark, "best"))
    return md.rank_models(results.drop("train_time")).withColumn("is_best", F.col("model") == best)


# ----------------------------------------------------- feature step digest

_DERIVED_SQL = """
  2024 - YearBuilt AS HouseAge, YearRemodAdd - YearBuilt AS RemodelAge,
  CAST(CASE WHEN YearRemodAdd - YearBuilt > 0 THEN 1 ELSE 0 END AS INTEGER) AS IsRemodeled,
  2024 - YearRemodAdd AS YearsAfterRemodel,
  coalesce(CAST(GrLivArea AS DOUBLE), 0.0::DOUBLE) + coalesce(CAST(TotalBsmtSF AS DOUBLE), 0.0::DOUBLE) AS TotalSF,
  CAST(FullBath AS DOUBLE) + HalfBath * 0.5::DOUBLE AS TotalBathrooms,
  CAST(CASE WHEN PoolArea > 0 THEN 1 ELSE 0 END AS INTEGER) AS HasPool,
  CAST(CASE WHEN GarageArea > 0 THEN 1 ELSE 0 END AS INTEGER) AS HasGarage,
  CAST(LotArea AS DOUBLE) / CAST(TotRmsAbvGrd + 1 AS DOUBLE) AS LotAreaPerRoom,
  CAST(GrLivArea AS DOUBLE) / (CAST(FullBath AS DOUBLE) + HalfBath * 0.5::DOUBLE + 1.0::DOUBLE) AS AreaPerBath,
  OverallQual * OverallCond AS QualityScore,
  CAST(OverallQual AS DOUBLE) / CAST(OverallCond + 1 AS DOUBLE) AS QualCondRatio,
  CAST(CASE WHEN OverallQual >= 8 THEN 1 ELSE 0 END AS INTEGER) AS IsHighQuality"""
_ADDED = ("HouseAge", "RemodelAge", "IsRemodeled", "YearsAfterRemodel", "TotalSF", "TotalBathrooms", "HasPool",
          "HasGarage", "LotAreaPerRoom", "AreaPerBath", "QualityScore", "QualCondRatio", "IsHighQuality",
          "NeighborhoodAvgPrice")
_CANDS = _NUM + _ADDED
_FE_SQL = with_listing(f""",
fe0 AS (SELECT *, {_DERIVED_SQL} FROM listing),
means AS (SELECT Neighborhood AS k, avg(CAST(SalePrice AS DOUBLE)) AS m FROM listing
          WHERE Neighborhood IS NOT NULL GROUP BY Neighborhood),
g AS (SELECT avg(m) AS d FROM means),
fe1 AS (SELECT fe0.*, coalesce(means.m, g.d) AS NeighborhoodAvgPrice
        FROM fe0 LEFT JOIN means ON fe0.Neighborhood = means.k CROSS JOIN g),
u AS (SELECT feature, v FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CANDS)} FROM fe1)
      ON {', '.join(_CANDS)} INTO NAME feature VALUE v)),
chosen AS (SELECT feature FROM u GROUP BY feature HAVING abs(skewness(v)) > 0.75 AND min(v) >= 0)
SELECT feature, count(v) AS n, round(avg(v), 3) AS mean FROM u
WHERE feature IN ({', '.join(repr(c) for c in _ADDED)}) GROUP BY feature
UNION ALL
SELECT feature || '_log', count(v), round(avg(ln(1 + v)), 3) FROM u
WHERE feature IN (SELECT feature FROM chosen) GROUP BY feature""")


@register("feature_engineering_all", "P17 P16 T7", _FE_SQL)
def feature_engineering_all(spark, sf):
    """Full feature step fitted on all rows (as the reference); per added
    column: non-NULL count and mean (the auto log set is data-dependent, the
    oracle re-derives it from the same skewness rule)."""
    df = listing(spark, sf).drop("id")
    return _added_digest(df, fe.fit_feature_engineer(df, "SalePrice"))


def _added_digest(df, model):
    out = model.transform(df)
    added = model.added
    one = out.agg(*[F.struct(F.lit(c).alias("feature"), F.count(F.col(c)).alias("n"),
                             F.round(F.avg(F.col(c).cast("double")), 3).alias("mean")).alias(f"s{i}")
                    for i, c in enumerate(added)])
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(added))])).alias("s")).select("s.*")


_FE_TRAIN_SQL = _FE_SQL.replace(
    "WHERE Neighborhood IS NOT NULL GROUP BY", f"WHERE Neighborhood IS NOT NULL AND {_TRAIN} GROUP BY").replace(
    "chosen AS (SELECT feature FROM u GROUP BY feature", f"ut AS (SELECT feature, v FROM (UNPIVOT (SELECT "
    f"{', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CANDS)} FROM fe1 WHERE {_TRAIN}) ON {', '.join(_CANDS)} INTO NAME feature VALUE v)),\n"
    "chosen AS (SELECT feature FROM ut GROUP BY feature")


@register("feature_engineering_train", "P17 T7", _FE_TRAIN_SQL)
def feature_engineering_train(spark, sf):
    """The feature step with means and skewed columns learned from the training
    rows alone, applied to all rows."""
    from ..operators.split import assign_split
    df = assign_split(listing(spark, sf))
    return _added_digest(df.drop("id"), fe.fit_feature_engineer(df, "SalePrice", fit_scope="train"))


# ----------------------------------------------------- preprocessing digest

_PRE_SQL = with_dirty_listing(""",
med AS (SELECT """ + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in _NUM) + """ FROM dirty_listing),
imp AS (SELECT id, """ + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM) + """,
               CASE WHEN """ + bucket_sql('id', 10000, 42) + """ < 2000 THEN 'test' ELSE 'train' END AS split
        FROM dirty_listing, med),
""" + _iqr_chain_sql("imp") + """,
q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.5) AS c_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 "
    f"THEN 1.0::DOUBLE ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}"
    for c in _NUM) + """ FROM s4 WHERE split = 'train')
SELECT split, count(*) AS n, """ + ", ".join(f"round(avg(({c} - c_{c}) / s_{c}), 6) AS mean_{c}" for c in _NUM) + """
FROM s4, q GROUP BY split""")


@register("preprocess_full", "T10 T1 F1 T8 T9", _PRE_SQL)
def preprocess_full(spark, sf):
    from ..roles import ColumnRoles
    d = dirty_listing(spark, sf).select("id", *_NUM)
    roles = ColumnRoles(categorical=(), ordinal=())
    pre = tr.preprocess(d, roles)
    return _round_cols(pre.data.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in _NUM]),
        [f"mean_{c}" for c in _NUM])


_CATS = ("MSZoning", "Street", "LotShape", "Utilities", "Neighborhood", "BldgType", "HouseStyle", "ExterQual")
_NOMINAL = _CATS[:-1]
_ENCODED_SQL = with_dirty_listing(f""",
modes AS ({" UNION ALL ".join(f"(SELECT '{c}' AS c, {c} AS v FROM dirty_listing WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _CATS)}),
med AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in _NUM)} FROM dirty_listing),
imp AS (SELECT id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM)},
               {", ".join(f"coalesce({c}, (SELECT v FROM modes WHERE c = '{c}')) AS {c}" for c in _CATS)},
               CASE WHEN {bucket_sql('id', 10000, 42)} < 2000 THEN 'test' ELSE 'train' END AS split
        FROM dirty_listing, med),
""" + _iqr_chain_sql("imp") + f""",
u AS (SELECT split, col, val FROM (UNPIVOT (SELECT split, {", ".join(_NOMINAL)} FROM s4) ON {", ".join(_NOMINAL)} INTO NAME col VALUE val))
SELECT split, 'ExterQual' AS feature, CAST(sum(CASE ExterQual WHEN 'Po' THEN 1 WHEN 'Fa' THEN 2 WHEN 'TA' THEN 3 WHEN 'Gd' THEN 4
       WHEN 'Ex' THEN 5 ELSE 3 END) AS BIGINT) AS total FROM s4 GROUP BY split
UNION ALL
SELECT split, col || '_' || val, count(*) FROM u WHERE val > (SELECT min(m.val) FROM u m WHERE m.col = u.col) GROUP BY split, col, val""")


@register("preprocess_encoded", "T10 T2 T4 T5 T6 F1 T9", _ENCODED_SQL)
def preprocess_encoded(spark, sf):
    """The whole preprocessing with its categories: per split, the sum of every
    encoded column (codes of the ordinal one, ones of the others)."""
    d = dirty_listing(spark, sf)
    pre = tr.preprocess(d.select("id", *_NUM, *_CATS))
    encoded = ["ExterQual", *pre.encoder.one_hot.dummy_names()]
    sums = pre.data.groupBy("split").agg(*[F.sum(F.col(f"`{c}`").cast("long")).alias(f"s{i}") for i, c in enumerate(encoded)])
    long = sums.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("total"))
                                                    for i, c in enumerate(encoded)])).alias("e"))
    return long.select("split", "e.feature", "e.total").where("total > 0")


_THREE = ("YearBuilt", "YearRemodAdd", "GrLivArea")


@register("three_column_scores", "M16 M17 P20 P21 ST1 S5 S6", _LINEAR_ROWS + _members("SELECT 0 AS task", "true")
          + ls.fits(_DISTINCT, [("ols", "linear_regression", 0.0)]) + f"""
SELECT way, YearBuilt::BIGINT AS "year", count(*) AS n,
       round(avg(greatest(round({' + '.join(['w0', *[f'w[{_DISTINCT.index(c) + 1}] * {c}' for c in _THREE]])}, 2), 0.0)), 0) AS price
FROM r, coef, (VALUES ('batch'), ('reloaded'), ('stream')) t(way) GROUP BY ALL""")
def three_column_scores(spark, sf):
    """Records with three of the fields, and others that the model does not
    know: the saved model, the batch sink and the stream price them alike, the
    rest of the features being 0."""
    from ..plans.stages import aligned
    train = _frame(spark, sf).filter(F.col("split") == "train")
    model = aligned(md.make_pipeline("linear_regression", _DISTINCT, "label").fit(train))
    again = md.load_model(md.save_model(model, _model_dir(spark, "three")))
    columns = ["id", *_THREE, "Neighborhood"]
    rows = listing(spark, sf).select(*columns)
    out = files.scratch_path(spark, "three-stream")
    ways = {"batch": md.predict_batch(model, rows, sink=files.scratch_path(spark, "three-batch")),
            "reloaded": md.predict_batch(again, rows),
            "stream": score_stream(spark, sf, again, out + "/data", out + "/checkpoint", columns=columns).join(rows, "id")}
    parts = [got.groupBy(F.col("YearBuilt").alias("year")).agg(
        F.lit(way).alias("way"), F.count("*").alias("n"), F.round(F.avg("PredictedPrice"), 0).alias("price")) for way, got in ways.items()]
    return reduce(DataFrame.unionByName, parts)


_RUN_ROWS = with_listing(f""",
imp AS (SELECT id, CAST(SalePrice AS DOUBLE) AS y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LINEAR)},
               {_TRAIN} AS train, {bucket_sql('id', 5, 43)} AS fold FROM listing),
""" + _iqr_chain_sql("imp") + f""",
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in _LINEAR)}
      FROM s4 WHERE train),
r AS MATERIALIZED (SELECT id, y, train, fold, {", ".join(f"({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in _LINEAR)}
                   FROM s4, q)""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("train_run", "M22 M9 M11 M10 S5 S6", _RUN_ROWS + _members(
    "SELECT unnest(range(0, 6)) AS task", "(t.task = 5 OR r.fold <> t.task)") + ls.fits(_LINEAR, _BASE_VARIANTS, _COLLINEAR) + f""",
folds AS ({ls.scores('c.task < 5 AND r.train AND r.fold = c.task', 'variant, task', _LINEAR, 'r')}),
tests AS ({ls.scores('c.task = 5 AND NOT r.train', 'variant', _LINEAR, 'r')})
SELECT 'fold' AS step, variant AS model, task::INTEGER AS fold, round(r2, 5) AS r2_score FROM folds
UNION ALL SELECT 'test', variant, NULL, round(r2, 4) FROM tests
UNION ALL SELECT 'choice', arg_max(variant, round(r2, 4) - list_position(['linear_regression', 'ridge', 'lasso'], variant) * 1e-9), NULL, NULL FROM tests""")
def train_run(spark, sf):
    """The resumable run over the linear family: fold scores, test scores and
    the choice, read back from what the run wrote."""
    from ..roles import ColumnRoles
    from .train_run import train_run as run
    out = run(listing(spark, sf).select("id", *_LINEAR, "SalePrice"), files.scratch_path(spark, "train-run"),
              ColumnRoles(categorical=(), ordinal=()), gram.LINEAR_FAMILY, engineer=False)
    none = F.lit(None)
    return (out.fold_scores.select(F.lit("fold").alias("step"), "model", "fold", F.round("r2_score", 5).alias("r2_score"))
            .unionByName(out.scores.select(F.lit("test").alias("step"), "model", none.cast("int").alias("fold"),
                                           F.col("test_r2").alias("r2_score")))
            .unionByName(spark.createDataFrame([("choice", out.best, None, None)],
                                               "step string, model string, fold int, r2_score double")))
