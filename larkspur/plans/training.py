"""Composed plans: preprocessing (T10), end-to-end training (M22), full
evaluation (M21)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import encode as en
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import models as md
from ..operators import profile as pf
from ..operators.split import assign_split
from ..roles import HOUSING, ColumnRoles
from ..sources.tables import cut_lineage, persisted


@dataclass
class Preprocessed:
    data: DataFrame              # all rows, encoded and scaled, with ``split``
    imputer: cl.ImputerModel
    encoder: en.CategoricalEncoderModel
    scaler: en.RobustScalerModel
    feature_cols: list


def preprocess(df: DataFrame, roles: ColumnRoles = HOUSING, key: str = "id", test_share: float = 0.2,
               seed: int = 42, outlier_threshold: float = 3.0, impute_extra=()) -> Preprocessed:
    """Impute -> IQR filter (fit path only) -> encode -> split -> robust
    scale fitted on train. The row-dropping step never runs when scoring.
    ``impute_extra`` adds numeric columns (e.g. derived ones) to the
    imputer only; scaling stays on the configured numeric columns."""
    from dataclasses import replace
    imp_roles = replace(roles, numeric=tuple(dict.fromkeys(tuple(roles.numeric) + tuple(impute_extra))))
    # every fit reads the input: its joins are made once
    with persisted(df) as df:
        imputer = cl.fit_imputer(df, imp_roles)
        imputed = imputer.transform(df)
        kept = cl.remove_outliers_iqr(imputed, roles.outlier, outlier_threshold)
        encoder = en.fit_categorical_encoder(kept, roles)
        encoded = encoder.transform(kept)
        split = assign_split(encoded, key, test_share, seed)
        r = roles.present(df)
        train = split.filter(F.col("split") == "train")
        scaler = en.fit_robust_scaler(train, r.numeric)
        data = cut_lineage(scaler.transform(split))
    feats = [c for c in data.columns if c not in (key, roles.target, "split")]
    return Preprocessed(data, imputer, encoder, scaler, feats)


def train_end_to_end(df: DataFrame, roles: ColumnRoles = HOUSING, names=md.MODEL_ORDER, key: str = "id",
                     model_path: str | None = None, select_metric: str = "test_r2"):
    """Features (fitted on all rows, as the reference) -> preprocess ->
    train every model -> select the best -> importance -> save.
    Returns (results, best_name, best_model, importance)."""
    feng = fe.fit_feature_engineer(df, roles.target, exclude=(key,))
    derived = feng.transform(df)
    from ..roles import numeric_columns
    extra = [c for c in numeric_columns(derived) if c not in (key, roles.target)]
    pre = preprocess(derived, roles, key, impute_extra=extra)
    label = roles.target
    data = pre.data.withColumn(label, F.col(label).cast("double"))
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    feats = [c for c in pre.feature_cols if c != key]
    results, fitted = md.train_models(train, test, feats, label, names, key)
    results = cut_lineage(results)
    best = md.select_best(results, select_metric).first()["model"]
    importance = md.feature_importance(fitted[best], feats, 20, df.sparkSession)
    # one artifact: feature step + imputer + encoder + scaler + assembler + model
    from .stages import feature_stages, preprocessing_stages, scoring_pipeline
    full = scoring_pipeline(feature_stages(feng) + preprocessing_stages(pre.imputer, pre.encoder, pre.scaler),
                            fitted[best])
    if model_path:
        md.save_model(full, model_path)
    return results, best, full, importance


def full_evaluation(model: PipelineModel, test: DataFrame, label: str, n_features: int, key: str = "id",
                    feature_names=None, results: DataFrame | None = None, df: DataFrame | None = None) -> dict:
    """Every report on the test rows as a dict of DataFrames: metrics with
    their gates, residual summary, errors by price range, Q-Q points, importance
    (with ``feature_names``), the ranking of all models (with their ``results``)
    and the correlations with the label (with the whole table ``df``). The
    predictions are made once."""
    pred = cut_lineage(model.transform(test).select(key, F.col(label).cast("double").alias("actual"),
                                                    F.col("prediction").alias("predicted")))
    out = {
        "metrics": ev.metric_gate(ev.regression_metrics(pred, n_features=n_features)),
        "residual_summary": ev.residual_summary(pred),
        "error_by_range": ev.error_by_range(pred),
        "qq": ev.qq_points(pred),
    }
    if feature_names is not None:
        out["importance"] = md.feature_importance(model, feature_names, 20, test.sparkSession)
    if results is not None:
        out["comparison"] = md.rank_models(results)
    if df is not None:
        out["correlation"] = pf.corr_with_target(df, label)
    return out


def report_rows(reports: dict) -> DataFrame:
    """The reports of :func:`full_evaluation` as one table (report, item, value);
    of the Q-Q points, the line."""
    def rows(report: str, frame: DataFrame, item, values) -> DataFrame:
        pairs = F.array(*[F.struct(F.concat(item, F.lit(v)).alias("item"), F.col(v).cast("double").alias("value")) for v in values])
        return frame.select(F.lit(report).alias("report"), F.explode(pairs).alias("e")).select("report", "e.*")

    none = F.lit("")
    parts = [rows("metrics", reports["metrics"], none, ("n", "r2_score", "adj_r2", "rmse", "mae", "mape", "mse")),
             rows("residuals", reports["residual_summary"], none, ("residual_mean", "residual_std")),
             rows("ranges", reports["error_by_range"], F.concat("range_label", F.lit("/")), ("mean_abs_error", "mean_pct_error", "count")),
             rows("qq", reports["qq"].agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept")), none, ("slope", "intercept"))]
    if "importance" in reports:
        parts.append(rows("importance", reports["importance"], F.concat("feature", F.lit("/")), ("importance",)))
    if "comparison" in reports:
        parts.append(rows("comparison", reports["comparison"], F.concat("model", F.lit("/")), ("test_r2", "test_rmse", "train_r2")))
    if "correlation" in reports:
        parts.append(rows("correlation", reports["correlation"], F.concat("column", F.lit("/")), ("corr",)))
    return reduce(DataFrame.unionByName, parts)


# Fixed value: the base numeric features used by the model queries.
MODEL_FEATURES = ("LotArea", "YearBuilt", "YearRemodAdd", "TotalBsmtSF", "GrLivArea", "FullBath", "HalfBath",
                  "BedroomAbvGr", "TotRmsAbvGrd", "GarageArea", "PoolArea", "OverallQual", "OverallCond")


def model_frame(df: DataFrame, key: str = "id", label: str = "SalePrice") -> DataFrame:
    """(key, features..., label double, split) from a housing-shaped table."""
    return assign_split(df.select(key, *MODEL_FEATURES, F.col(label).cast("double").alias("label")), key)


def scaled_pipeline(train: DataFrame, name: str, features=MODEL_FEATURES, label: str = "label") -> PipelineModel:
    """Reduced derivation, alignment, robust scaler (as a SQL stage), assembler
    and estimator as one artifact: records with absent or extra fields score."""
    from pyspark.ml import Pipeline
    from .stages import aligned
    scaler = en.fit_robust_scaler(train, features)
    n, s = md.label_stats(train, label)
    stages = [scaler.to_stage("_scaled"),
              VectorAssembler(inputCols=[f"{c}_scaled" for c in features], outputCol="features",
                              handleInvalid="keep"),
              md.make_estimator(name, label=label, n_rows=n, label_std=s)]
    return aligned(Pipeline(stages=stages).fit(train), raw=features)
