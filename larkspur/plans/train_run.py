"""End-to-end training as a resumable run (M22): features -> preprocessing ->
fit every model -> cross-validate every model -> choose the best -> tune it ->
evaluate it again -> importance -> one artifact.

Every step leaves its result under the run's folder (shared storage) before the
next begins: the prepared rows, each model, its scores and fold scores, the
choice, the tuning points, the tuned model and the artifact. A run that was
broken off is started again with the same folder and goes on where it stopped;
what is there is read, not computed again. Steps are marked done by the file
that Spark's writers leave last.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import gram
from ..operators import models as md
from ..operators.evaluate import regression_metrics
from ..roles import HOUSING, ColumnRoles, numeric_columns
from ..sources.files import path_exists
from .stages import feature_stages, preprocessing_stages, scoring_pipeline
from .training import preprocess


@dataclass
class RunResult:
    scores: DataFrame        # model, ordinal, train_r2, test_r2, test_rmse, r2_gap, train_time
    fold_scores: DataFrame   # model, ordinal, fold, r2_score
    best: str
    tuning: DataFrame        # params, cv_r2 (no rows where the best model has no grid)
    evaluation: DataFrame    # variant (base, tuned), r2_score, rmse
    importance: DataFrame
    model: PipelineModel     # scores raw rows


class TrainRun:
    def __init__(self, df: DataFrame, folder: str, roles: ColumnRoles = HOUSING, names=md.MODEL_ORDER, key: str = "id",
                 engineer: bool = True, folds: int = 5, parallelism: int = 4, grids: dict | None = None):
        self.df, self.folder, self.roles, self.names, self.key = df, folder.rstrip("/"), roles, tuple(names), key
        self.engineer, self.folds, self.parallelism = engineer, folds, parallelism
        self.grids = md.GRIDS if grids is None else grids
        self.spark = df.sparkSession
        self.computed: list[str] = []     # the steps that this run did itself

    # -- steps that leave a table or a model

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            self.computed.append(name)
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _model(self, name: str, make: Callable[[], PipelineModel]) -> PipelineModel:
        path = f"{self.folder}/{name}"
        if not path_exists(self.spark, f"{path}.done/_SUCCESS"):
            self.computed.append(name)
            md.save_model(make(), path)
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}.done")
        return md.load_model(path, self.spark)

    # -- the run

    def prepare(self) -> None:
        """Fit the feature step and the preprocessing; keep rows and stages."""
        def fit() -> PipelineModel:
            stages, derived, extra = [], self.df, []
            if self.engineer:
                step = fe.fit_feature_engineer(self.df, self.roles.target, exclude=(self.key,))
                stages, derived = feature_stages(step), step.transform(self.df)
                extra = [c for c in numeric_columns(derived) if c not in (self.key, self.roles.target)]
            pre = preprocess(derived, self.roles, self.key, impute_extra=extra)
            self._table("prepared", lambda: pre.data)
            return PipelineModel(stages=stages + preprocessing_stages(pre.imputer, pre.encoder, pre.scaler))

        self.steps = self._model("steps", fit)
        label = self.roles.target
        data = self.spark.read.parquet(f"{self.folder}/prepared").withColumn(label, F.col(label).cast("double"))
        self.features = [c for c in data.columns if c not in (self.key, label, "split")]
        self.train, self.test = data.where("split = 'train'"), data.where("split = 'test'")
        self.stats = None

    def _label_stats(self):
        if self.stats is None:
            self.stats = md.label_stats(self.train, self.roles.target)
        return self.stats

    def fit(self, name: str) -> tuple[PipelineModel, DataFrame]:
        """The fitted model and its scores; the time is that of the fit."""
        took = [0.0]

        def make() -> PipelineModel:
            n, s = self._label_stats()
            pipe = md.make_pipeline(name, self.features, self.roles.target, n_rows=n, label_std=s)
            began = time.time()
            model = pipe.fit(self.train)
            took[0] = time.time() - began
            return model

        model = self._model(f"models/{name}", make)
        scored = [model.transform(rows).select(F.lit(split).alias("split"), F.col(self.roles.target).alias("actual"),
                                               F.col("prediction").alias("predicted"))
                  for split, rows in (("train", self.train), ("test", self.test))]

        def score() -> DataFrame:
            m = regression_metrics(scored[0].unionByName(scored[1]), by=["split"], rounded=False)
            table = md.results_table(m.select(F.lit(name).alias("model"), F.lit(self.names.index(name) + 1).alias("ordinal"), "*"))
            return table.withColumn("train_time", F.lit(took[0]))

        return model, self._table(f"scores/{name}", score)

    def cross_validate(self) -> DataFrame:
        """Fold scores of every model: the linear family from one scan."""
        ordinal = F.create_map(*[x for i, n in enumerate(self.names, 1) for x in (F.lit(n), F.lit(i))])
        parts = []
        linear = {n: (n, 1.0) for n in self.names if n in gram.LINEAR_FAMILY}
        if linear:
            parts.append(self._table("folds/linear", lambda: gram.fold_scores(
                self.train, self.features, self.roles.target, linear, self.folds, self.key).select(
                F.col("variant").alias("model"), "fold", "r2_score")))
        for name in (n for n in self.names if n not in linear):
            parts.append(self._table(f"folds/{name}", lambda name=name: md.cross_validate(
                self.train, self.features, self.roles.target, (name,), self.folds, key=self.key, parallelism=self.parallelism)
                .select("model", F.explode("fold_r2").alias("f")).select("model", "f.fold", "f.r2_score")))
        return reduce(DataFrame.unionByName, parts).select("model", ordinal[F.col("model")].alias("ordinal"), "fold", "r2_score")

    def tune(self, best: str) -> tuple[PipelineModel, DataFrame]:
        """Grid search of the chosen model; without a grid it stays as it is."""
        found: list = []

        def search() -> PipelineModel:
            model, points = md.grid_search(self.train, self.features, self.roles.target, best, self.grids.get(best, {}),
                                           parallelism=self.parallelism, key=self.key)
            found.extend((str(p), float(s)) for p, s in points or [])
            self._table("tuning", lambda: self.spark.createDataFrame(found, "params string, cv_r2 double"))
            return model

        tuned = self._model("tuned", search)
        return tuned, self.spark.read.parquet(f"{self.folder}/tuning")

    def run(self) -> RunResult:
        self.prepare()
        at_once = md.fits_at_once(self._label_stats()[0], len(self.features), self.parallelism)
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            fitted = dict(zip(self.names, pool.map(self.fit, self.names), strict=True))
        scores = reduce(DataFrame.unionByName, [s for _, s in fitted.values()])
        fold_scores = self.cross_validate()
        best = self._table("choice", lambda: md.select_best(scores).select("model")).first()["model"]
        tuned, tuning = self.tune(best)
        variants = [m.transform(self.test).select(F.lit(v).alias("variant"), F.col(self.roles.target).alias("actual"),
                                                  F.col("prediction").alias("predicted"))
                    for v, m in (("base", fitted[best][0]), ("tuned", tuned))]
        evaluation = self._table("evaluation", lambda: regression_metrics(
            variants[0].unionByName(variants[1]), by=["variant"], rounded=False).select("variant", "n", "r2_score", "rmse"))
        importance = self._table("importance", lambda: md.feature_importance(tuned, self.features, 20, self.spark))
        model = self._model("artifact", lambda: scoring_pipeline(list(self.steps.stages), tuned))
        return RunResult(scores, fold_scores, best, tuning, evaluation, importance, model)


def train_run(df: DataFrame, folder: str, roles: ColumnRoles = HOUSING, names=md.MODEL_ORDER, key: str = "id",
              **options) -> RunResult:
    return TrainRun(df, folder, roles, names, key, **options).run()
