"""Models (M1-M7), training loop (M8), cross-validation (M9), grid search
(M10), selection and ranking (M11-M13), importance (M14-M15, M20),
scoring (M16-M17) and persistence (S5-S6), on ``pyspark.ml``.

Data-parallel MLlib does the training; the driver only loops over model
names. The assembled training frame is persisted once and reused by every
fit; evaluation metrics come from one grouped aggregation.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import path_exists
from ..sources.tables import cut_lineage
from . import gram
from .boosting import BlockGBTRegressor
from .evaluate import regression_metrics
from .split import assign_folds

SEED = 42
# Execution-only tree settings (same model): the statistics of the nodes that
# one pass splits, which every running task holds, stay within 256 MB; node ids
# cached between levels, lineage cut every 10 iterations into the session's
# checkpoint folder.
TREE_EXEC = dict(maxMemoryInMB=256, cacheNodeIds=True, checkpointInterval=10)
# A forest's node ids are one number per row and tree, held twice while they
# change: they are found again from the trees instead.
FOREST_EXEC = TREE_EXEC | dict(cacheNodeIds=False)
TREES = ("decision_tree", "random_forest", "gradient_boosting", "xgboost")
# So do all fits of a pipeline (the same trees): a walk of ten steps or fewer costs
# less than node ids written anew for every row and level, two levels of them held.
FIT_EXEC = dict(cacheNodeIds=False)
# A fit of trees keeps its rows as points until it ends: about 130 bytes of objects
# and 4 bytes a feature. Fits run side by side while their points together stay
# below this; larger ones fill the cluster one at a time.
POINT_BYTES, POINTS_AT_ONCE = 130, 2 << 30
# Spark caps tree depth at 30; an "unlimited" depth maps to this cap.
UNLIMITED_DEPTH = 10
MODEL_ORDER = ("linear_regression", "ridge", "lasso", "decision_tree", "random_forest",
               "gradient_boosting", "xgboost")


def make_estimator(name: str, label: str = "label", features: str = "features", n_rows: int | None = None,
                   label_std: float | None = None, alpha: float = 1.0, **params):
    """One estimator with the reference's default settings (M1-M7)."""
    common = dict(featuresCol=features, labelCol=label, predictionCol="prediction")
    if name in TREES:
        from ..session import ensure_checkpoint_dir
        from pyspark.sql import SparkSession
        active = SparkSession.getActiveSession()
        if active is not None:
            ensure_checkpoint_dir(active)
    if name == "linear_regression":
        est = LinearRegression(regParam=0.0, solver="auto", **common)
    elif name == "ridge":
        # sklearn alpha*||w||^2 on the raw sum of squares == Spark's
        # (1/2n) objective with a standardised label: lambda = alpha*std(y)/n
        lam = alpha * (label_std or 1.0) / max(n_rows or 1, 1)
        # pure L2: the normal-equation solver is exact (no line search)
        est = LinearRegression(regParam=lam, elasticNetParam=0.0, standardization=False,
                               solver="normal", **common)
    elif name == "lasso":
        est = LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False,
                               maxIter=200, tol=1e-9, **common)
    elif name == "decision_tree":
        est = DecisionTreeRegressor(maxDepth=UNLIMITED_DEPTH, maxBins=256, seed=SEED, **TREE_EXEC, **common)
    elif name == "random_forest":
        est = RandomForestRegressor(numTrees=100, featureSubsetStrategy="all", maxDepth=UNLIMITED_DEPTH,
                                    maxBins=256, seed=SEED, **FOREST_EXEC, **common)
    elif name == "gradient_boosting":
        est = BlockGBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED, **TREE_EXEC, **common)
    elif name == "xgboost":
        # histogram-boosted trees re-aimed to MLlib GBT (depth 6, rate 0.3)
        est = BlockGBTRegressor(maxIter=100, maxDepth=6, stepSize=0.3, maxBins=256, seed=SEED, **TREE_EXEC, **common)
    else:
        raise ValueError(f"unknown model {name!r}")
    if params:
        est = est.copy({est.getParam(k): v for k, v in params.items()})
    return est


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def make_pipeline(name: str, features, label: str = "label", **kw) -> Pipeline:
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, make_estimator(name, label=label, **((FIT_EXEC if name in TREES else {}) | kw))])


def label_stats(df: DataFrame, label: str):
    r = df.agg(F.count(F.col(label)).alias("n"), F.stddev_samp(F.col(label).cast("double")).alias("s")).first()
    return int(r["n"]), float(r["s"] or 1.0)


def fits_at_once(n_rows: int, n_features: int, parallelism: int = 4) -> int:
    """How many fits of ``n_rows`` run side by side, ``parallelism`` at most."""
    points = max(1, n_rows) * (POINT_BYTES + 4 * n_features)
    return max(1, min(parallelism, POINTS_AT_ONCE // points))


@dataclass
class TrainResult:
    name: str
    model: PipelineModel
    train_time: float


def train_models(train: DataFrame, test: DataFrame, features, label: str = "label", names=MODEL_ORDER,
                 key: str = "id", overrides: dict | None = None, parallelism: int = 4):
    """M8: fit every named model; return (results DataFrame, {name: model}).

    Fits run as concurrent Spark jobs from up to ``parallelism`` driver
    threads (each fit is itself data-parallel; concurrency fills the cluster
    when one model's jobs are too small to; of many rows fewer at a time,
    :func:`fits_at_once`). Seeds are fixed, so results do not depend on the
    interleaving. The results table has one row per
    model: train_r2, test_r2, test_rmse, train_time (wall time of the fit,
    which overlaps with the others), from one grouped metrics aggregation
    over the union of all predictions."""
    from concurrent.futures import ThreadPoolExecutor
    spark = train.sparkSession
    train = train.persist()
    n, s = label_stats(train, label)
    fitted, times, preds = {}, {}, []

    def fit_one(name):
        pipe = make_pipeline(name, features, label, n_rows=n, label_std=s, **(overrides or {}).get(name, {}))
        t0 = time.time()
        model = pipe.fit(train)
        return name, model, time.time() - t0

    with ThreadPoolExecutor(max_workers=fits_at_once(n, len(features), parallelism)) as pool:
        done = list(pool.map(fit_one, names))
    for i, (name, model, secs) in enumerate(done, 1):
        times[name] = secs
        fitted[name] = model
        for split, frame in (("train", train), ("test", test)):
            preds.append(model.transform(frame).select(
                F.lit(name).alias("model"), F.lit(i).alias("ordinal"), F.lit(split).alias("split"),
                F.col(label).cast("double").alias("actual"), F.col("prediction").alias("predicted")))
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    m = regression_metrics(allp, by=["model", "ordinal", "split"], rounded=False)
    tt = spark.createDataFrame([(k, float(v)) for k, v in times.items()], "model string, train_time double")
    res = cut_lineage(results_table(m).join(tt, "model", "left"))   # one row per model
    train.unpersist()
    return res, fitted


def results_table(metrics: DataFrame) -> DataFrame:
    """Pivot per-split metrics (model, ordinal, split, r2_score, rmse...) to
    one row per model with the train-test gap (M12/M13)."""
    t = metrics.filter(F.col("split") == "test").select(
        "model", "ordinal", F.round("r2_score", 4).alias("test_r2"), F.round("rmse", 2).alias("test_rmse"))
    tr = metrics.filter(F.col("split") == "train").select("model", F.round("r2_score", 4).alias("train_r2"))
    return t.join(tr, "model").select(
        "model", "ordinal", "train_r2", "test_r2", "test_rmse",
        F.round(F.col("train_r2") - F.col("test_r2"), 4).alias("r2_gap"))


def select_best(results: DataFrame, metric: str = "test_r2") -> DataFrame:
    """Argmax of the metric, the first model (ordinal) wins ties."""
    return results.orderBy(F.desc(metric), F.asc("ordinal")).limit(1)


def rank_models(results: DataFrame, metric: str = "test_r2") -> DataFrame:
    """Ranking table sorted by the metric."""
    return results.orderBy(F.desc(metric), F.asc("ordinal"))


def cross_validate(df: DataFrame, features, label: str = "label", names=MODEL_ORDER, k: int = 5,
                   fold_col: str = "fold", key: str = "id", parallelism: int = 4) -> DataFrame:
    """M9: R2 per fold, mean and population std per model, with hash folds.
    The linear family is fitted and scored from the moments of the folds, one
    scan for all its models (``operators.gram``). The other model x fold fits run
    as concurrent Spark jobs from up to ``parallelism`` driver threads, fewer of
    many rows (:func:`fits_at_once`)."""
    from concurrent.futures import ThreadPoolExecutor

    data = assign_folds(df, key, k, col=fold_col).persist()
    linear = {name: (name, 1.0) for name in names if name in gram.LINEAR_FAMILY}
    order = {name: i for i, name in enumerate(names, 1)}

    def fit_fold(task):
        i, name, f = task
        tr = data.filter(F.col(fold_col) != f)
        te = data.filter(F.col(fold_col) == f)
        model = make_pipeline(name, features, label).fit(tr)
        return model.transform(te).select(F.lit(name).alias("model"), F.lit(i).alias("ordinal"),
                                          F.lit(f).alias("fold"), F.col(label).cast("double").alias("actual"),
                                          F.col("prediction").alias("predicted"))

    tasks = [(i, name, f) for name, i in order.items() if name not in linear for f in range(k)]
    rows = []
    if tasks:
        with ThreadPoolExecutor(max_workers=fits_at_once(data.count(), len(features), parallelism)) as pool:
            rows = list(pool.map(fit_fold, tasks))
    parts = []
    if linear:
        scored = gram.fold_scores(data, features, label, linear, k, key, fold_col=fold_col)
        place = F.create_map(*[x for name in linear for x in (F.lit(name), F.lit(order[name]))])
        parts.append(scored.select(F.col("variant").alias("model"), place[F.col("variant")].alias("ordinal"), "fold", "r2_score"))
    if rows:
        allp = reduce(DataFrame.unionByName, rows)
        parts.append(regression_metrics(allp, by=["model", "ordinal", "fold"], rounded=False)
                     .select("model", "ordinal", "fold", "r2_score"))
    per_fold = reduce(DataFrame.unionByName, parts)
    out = per_fold.groupBy("model", "ordinal").agg(
        F.collect_list(F.struct("fold", "r2_score")).alias("fold_r2"),
        F.avg("r2_score").alias("cv_mean"), F.stddev_pop("r2_score").alias("cv_std"))
    out = cut_lineage(out)          # one row per model, materialised before the input is released
    data.unpersist()
    return out


# The reference's tuning grids, names mapped to MLlib params. Leaf
# penalties and the split minimum have no MLlib counterpart; no depth limit is 30.
GRIDS = {
    "xgboost": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 5, 7],
                "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "1.0"],
                "minInstancesPerNode": [1, 3]},
    "random_forest": {"numTrees": [100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2]},
    "gradient_boosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 5]},
    "ridge": {"regParam": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
}


# The folds of tuning are independent of those of cross-validation.
TUNING_SEED, TUNING_FOLD = 1042, "tuning_fold"


def grid_search(train: DataFrame, features, label: str = "label", name: str = "ridge", grid: dict | None = None,
                folds: int = 3, cheap: bool = False, parallelism: int = 4, key: str = "id"):
    """Grid search by R2 with refit on all training rows, on hash folds of
    the key (``cheap``: one of five validates). Penalties of the linear family
    are scored from the moments of the folds, all from one scan. Boosted trees
    that differ in ``maxIter`` alone come from one fit at the largest of them
    (:func:`staged_scores`). Unknown model names are returned untuned."""
    grid = grid if grid is not None else GRIDS.get(name)
    n, s = label_stats(train, label)
    pipe = make_pipeline(name, features, label, n_rows=n, label_std=s)
    if not grid:
        return pipe.fit(train), None
    if name in ("ridge", "lasso") and set(grid) == {"regParam"}:
        best, _, scores = gram.alpha_grid(train, features, label, name, grid["regParam"], 5 if cheap else folds, key,
                                          TUNING_SEED, 1 if cheap else None)
        tuned = make_pipeline(name, features, label, n_rows=n, label_std=s, alpha=best)
        return tuned.fit(train), [({"alpha": a}, r2) for a, r2 in scores]
    if name in ("gradient_boosting", "xgboost") and len(grid.get("maxIter", ())) > 1:
        return _staged_search(train, features, label, name, pipe, grid, folds, cheap, parallelism, key)
    est = pipe.getStages()[-1]
    b = ParamGridBuilder()
    for k, vals in grid.items():
        b = b.addGrid(est.getParam(k), vals)
    maps = b.build()
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2")
    names = [{p.name: v for p, v in m.items()} for m in maps]
    if cheap:
        held = assign_folds(train, key, 5, TUNING_SEED, TUNING_FOLD)
        fit, check = held.where(F.col(TUNING_FOLD) != 0), held.where(F.col(TUNING_FOLD) == 0)
        metrics = [ev.evaluate(pipe.fit(fit, m).transform(check)) for m in maps]
        best = max(range(len(maps)), key=lambda i: (metrics[i], -i))
        return pipe.fit(train, maps[best]), list(zip(names, metrics))
    tuner = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=folds,
                           foldCol=TUNING_FOLD, parallelism=fits_at_once(n, len(features), parallelism))
    model = tuner.fit(assign_folds(train, key, folds, TUNING_SEED, TUNING_FOLD))
    return model.bestModel, list(zip(names, model.avgMetrics))


def staged_scores(model: PipelineModel, df: DataFrame, label: str, counts: list[int]) -> dict[int, float]:
    """R2 of the first m trees of a boosted model, for each m of ``counts``:
    one pass over ``df`` for all of them."""
    stage = model.stages[-1]
    for step in model.stages[:-1]:
        df = step.transform(df)
    errors = stage.evaluateEachIteration(df, "squared")
    spread = df.agg(F.var_pop(F.col(label).cast("double")).alias("v")).first()["v"]
    return {m: 1.0 - errors[m - 1] / spread if spread else float(errors[m - 1] == 0) for m in counts}


def _staged_search(train, features, label, name, pipe, grid, folds, cheap, parallelism, key):
    """Grid search of boosted trees: a fit at the largest ``maxIter`` scores
    every smaller one, as boosting adds trees without changing those before."""
    from concurrent.futures import ThreadPoolExecutor
    est = pipe.getStages()[-1]
    counts = sorted(grid["maxIter"])
    b = ParamGridBuilder().addGrid(est.maxIter, counts[-1:])
    for k, vals in grid.items():
        if k != "maxIter":
            b = b.addGrid(est.getParam(k), vals)
    maps = b.build()
    k = 5 if cheap else folds
    data = assign_folds(train, key, k, TUNING_SEED, TUNING_FOLD).persist()

    def fit(task):
        m, fold = task
        model = pipe.fit(data.where(F.col(TUNING_FOLD) != fold), m)
        return staged_scores(model, data.where(F.col(TUNING_FOLD) == fold), label, counts)

    tasks = [(m, fold) for m in maps for fold in ([0] if cheap else range(k))]
    with ThreadPoolExecutor(max_workers=fits_at_once(data.count(), len(features), parallelism)) as pool:
        got = list(pool.map(fit, tasks))
    data.unpersist()
    scores, points = [], []
    for i, m in enumerate(maps):
        mine = got[i * len(tasks) // len(maps):(i + 1) * len(tasks) // len(maps)]
        for n in counts:
            point = {p: (n if p.name == "maxIter" else v) for p, v in m.items()}
            points.append(point)
            scores.append(({p.name: v for p, v in point.items()}, sum(g[n] for g in mine) / len(mine)))
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    return pipe.fit(train, points[best]), scores


def feature_importance(model, feature_names, top_n: int = 20, spark=None) -> DataFrame:
    """Importance share sorted descending with rank; models
    without importances give an empty table."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    spark = spark or __import__("pyspark").sql.SparkSession.getActiveSession()
    schema = "feature string, importance double, rank int"
    if not hasattr(stage, "featureImportances"):
        return spark.createDataFrame([], schema)
    imp = stage.featureImportances.toArray().tolist()
    rows = sorted(zip(feature_names, imp), key=lambda t: (-t[1], t[0]))[:top_n]
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)], schema)


def linear_contributions(df: DataFrame, coefficients: dict, intercept: float, key: str = "id") -> DataFrame:
    """Exact per-row contributions coef * (x - mean(x)) of a linear
    model; base_value = prediction at the mean. Means in one aggregation."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in coefficients]).first()
    cols = [F.col(key)]
    for c, w in coefficients.items():
        cols.append((F.lit(float(w)) * (F.col(c).cast("double") - F.lit(means[f"m_{c}"]))).alias(f"contrib_{c}"))
    base = F.lit(float(intercept))
    for c, w in coefficients.items():
        base = base + F.lit(float(w)) * F.lit(means[f"m_{c}"])
    return df.select(*cols, base.alias("base_value"))


def linear_coefficients(model) -> tuple[list[float], float]:
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    return stage.coefficients.toArray().tolist(), float(stage.intercept)


def _with_rank(df: DataFrame, order, name: str) -> DataFrame:
    """``name``: the 0-based place of every row in the given order, from a range
    partitioning and the row counts of the ranges before."""
    from pyspark.sql import Window
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").count().select(       # one row per range
        "_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_row", inside).join(before, "_part")
            .withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before"))


def permutation_importance(model, df: DataFrame, features, label: str = "label", key: str = "id",
                           seed: int = SEED) -> DataFrame:
    """Model-free importance: drop in R2 when one feature's values are
    permuted across rows. The permutation joins two hash orders of the whole
    table; it depends on the keys alone. The base and all permuted variants are
    one long table, scored in one pass and measured by one grouped aggregate."""
    from ..functions.hashing import mix_key
    features = list(features)
    first = _with_rank(df.select(key, label, *features), [mix_key(key, seed + 1), F.col(key)], "_place")
    donors = _with_rank(df.select(key, *features), [mix_key(key, seed + 2), F.col(key)], "_place").drop(key)
    donors = donors.select("_place", *[F.col(f).alias(f"_{f}") for f in features])
    both = first.join(donors, "_place")
    variants = F.array(F.lit(None).cast("string"), *[F.lit(f) for f in features])
    long = both.select("*", F.explode(variants).alias("_variant"))
    long = long.select("_variant", F.col(label).cast("double").alias("_actual"), *[
        F.when(F.col("_variant") == f, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    scored = model.transform(long).select("_variant", F.col("_actual").alias("actual"), F.col("prediction").alias("predicted"))
    r2 = regression_metrics(scored, by=["_variant"], rounded=False).select("_variant", "r2_score")
    r2 = cut_lineage(r2)              # one row per variant
    base = r2.where("_variant is null").select(F.col("r2_score").alias("_base"))
    drop = r2.where("_variant is not null").crossJoin(base)      # one row beside every feature
    return drop.select(F.col("_variant").alias("feature"), (F.col("_base") - F.col("r2_score")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


# --------------------------------------------------------------- persistence

def save_model(model: PipelineModel, path: str) -> str:
    """One artifact (scaler + model stages), overwriting."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str, spark: SparkSession | None = None) -> PipelineModel:
    """Raise when the artifact is absent from the path's file system."""
    if not path_exists(spark or SparkSession.getActiveSession(), path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def predict_batch(model, df: DataFrame, output: str = "PredictedPrice", sink: str | None = None) -> DataFrame:
    """Input columns kept, prediction rounded half-even then clamped at 0."""
    scored = model.transform(df)
    out = df.columns + [output]
    price = F.greatest(F.bround(F.col("prediction"), 2), F.lit(0.0))
    res = scored.withColumn(output, F.when(F.col("prediction").isNotNull(), price)).select(*out)
    if not sink:
        return res
    # scored once: the result is what the sink holds
    res.write.mode("overwrite").option("header", True).csv(sink)
    return df.sparkSession.read.schema(res.schema).option("header", True).csv(sink)
