"""Class facade with the method names of the reference's public surface
(SURVEY §2.14), each delegating to the Spark operators. Frames are Spark
DataFrames that keep their key and target columns: no positional X/y
alignment is ever needed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean as cl
from .operators import encode as en
from .operators import evaluate as ev
from .operators import features as fe
from .operators import models as md
from .operators import pricing as pr
from .operators import profile as pf
from .operators.split import assign_split
from .roles import HOUSING, ColumnRoles, split_features_target
from .sources import files


@dataclass
class Config:
    roles: ColumnRoles = HOUSING
    key: str = "id"
    test_size: float = 0.2
    random_state: int = 42
    numerical_strategy: str = "median"
    outlier_threshold: float = 3.0
    raw_data_path: str | None = None
    model_path: str | None = None
    cv_splits: int = 5
    r2_gate: float = ev.R2_GATE
    rmse_gate: float = ev.RMSE_GATE
    models: tuple = md.MODEL_ORDER
    extra: dict = field(default_factory=dict)


class DataLoader:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def load_data(self, schema=None, fallback=None) -> DataFrame:
        """The configured file; ``fallback`` (a function that gives a table)
        serves where the file is absent."""
        if fallback is not None:
            return files.read_csv_or(self.spark, self.config.raw_data_path, fallback, schema)
        return files.read_csv(self.spark, self.config.raw_data_path, schema)

    def profile_data(self, df: DataFrame) -> dict:
        t = self.config.roles.target
        return {"shape": pf.profile_shape(df), "missing": pf.missing_report(df, only_missing=False),
                "duplicates": pf.duplicate_count(df), "numerical_stats": pf.numeric_describe(df),
                "target_stats": pf.target_stats(df, t) if t in df.columns else None}

    def split_features_target(self, df: DataFrame):
        return split_features_target(df, self.config.roles.target)


class FeatureEngineer:
    def __init__(self, config: Config | None = None):
        self.config = config or Config()
        self.model: fe.FeatureEngineerModel | None = None
        self.encoder: fe.TargetEncoderModel | None = None

    def add_age_features(self, df):
        return fe.add_age_features(df)

    def add_area_features(self, df):
        return fe.add_area_features(df)

    def add_quality_features(self, df):
        return fe.add_quality_features(df)

    def add_neighborhood_features(self, df, fit: bool = True):
        if fit and self.config.roles.target in df.columns:
            self.encoder = fe.fit_target_encoder(df, "Neighborhood", self.config.roles.target)
        return self.encoder.transform(df) if self.encoder else df

    def apply_log_transform(self, df, columns=None):
        return fe.apply_log_transform(df, columns, self.config.roles.target)

    def run_all(self, df, fit: bool = True):
        if fit or self.model is None:
            self.model = fe.fit_feature_engineer(df, self.config.roles.target, exclude=(self.config.key,))
        return self.model.transform(df)


class DataPreprocessor:
    def __init__(self, config: Config | None = None):
        self.config = config or Config()
        self.imputer = self.encoder = self.scaler = None

    def handle_missing_values(self, df):
        self.imputer = cl.fit_imputer(df, self.config.roles, self.config.numerical_strategy)
        return self.imputer.transform(df)

    def remove_outliers(self, df, method: str = "iqr", threshold: float = 3.0):
        return cl.remove_outliers(df, method, threshold, self.config.roles.outlier)

    def encode_categoricals(self, df):
        self.encoder = en.fit_categorical_encoder(df, self.config.roles)
        return self.encoder.transform(df)

    def scale_features(self, train, test):
        self.scaler = en.fit_robust_scaler(train, self.config.roles.numeric)
        return self.scaler.transform(train), self.scaler.transform(test)

    def split_data(self, df):
        s = assign_split(df, self.config.key, self.config.test_size, self.config.random_state)
        return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")

    def run_pipeline(self, df):
        from .plans.training import preprocess
        pre = preprocess(df, self.config.roles, self.config.key, self.config.test_size,
                         self.config.random_state, self.config.outlier_threshold)
        self.imputer, self.encoder, self.scaler = pre.imputer, pre.encoder, pre.scaler
        data = pre.data
        return (data.filter(F.col("split") == "train").drop("split"),
                data.filter(F.col("split") == "test").drop("split"))


class ModelTrainer:
    def __init__(self, config: Config | None = None):
        self.config = config or Config()

    def train_baseline_models(self, train, test, features, label=None):
        return md.train_models(train, test, features, label or self.config.roles.target, self.config.models,
                               self.config.key)

    def cross_validate_models(self, df, features, label=None):
        return md.cross_validate(df, features, label or self.config.roles.target, self.config.models,
                                 self.config.cv_splits, key=self.config.key)

    def tune_best_model(self, train, features, model_name: str = "xgboost", label=None, cheap: bool = False):
        return md.grid_search(train, features, label or self.config.roles.target, model_name, cheap=cheap)

    def select_best_model(self, results, metric: str = "test_r2"):
        return md.select_best(results, metric).first()["model"]

    def get_feature_importance(self, model, feature_names, top_n: int = 20):
        return md.feature_importance(model, feature_names, top_n)

    def save_model(self, model, filepath=None):
        return md.save_model(model, filepath or self.config.model_path)

    def load_model(self, filepath=None):
        return md.load_model(filepath or self.config.model_path)

    def load_or_train(self, df, filepath=None):
        """The saved model where there is one, else that of a resumable run
        beside its path (``<path>.run``), which is saved there."""
        from .plans.train_run import train_run
        path = filepath or self.config.model_path
        if files.path_exists(df.sparkSession, path):
            return md.load_model(path)
        run = train_run(df, f"{path}.run", self.config.roles, self.config.models, self.config.key, folds=self.config.cv_splits)
        md.save_model(run.model, path)
        return run.model

    def main(self, df):
        from .plans.training import train_end_to_end
        return train_end_to_end(df, self.config.roles, self.config.models, self.config.key, self.config.model_path)


class ModelEvaluator:
    def __init__(self, config: Config | None = None):
        self.config = config or Config()

    def compute_metrics(self, pred: DataFrame, n_features: int = 1, label="actual", prediction="predicted"):
        return ev.metric_gate(ev.regression_metrics(pred, label, prediction, n_features),
                              self.config.r2_gate, self.config.rmse_gate)

    def actual_vs_predicted(self, pred, label="actual", prediction="predicted"):
        return ev.residuals(pred, label, prediction, self.config.key)

    def feature_importance(self, model, names, top_n: int = 20):
        return md.feature_importance(model, names, top_n)

    def correlation_heatmap(self, df, top_n: int = 15):
        return pf.corr_matrix_top(df, self.config.roles.target, top_n)

    def model_comparison(self, results):
        return md.rank_models(results)

    def residual_distribution(self, pred, label="actual", prediction="predicted", bins: int = 50):
        r = pred.select((F.col(label) - F.col(prediction)).alias("residual"))
        return {"histogram": pf.histogram(r, "residual", bins), "qq": ev.qq_points(pred, label, prediction)}

    def full_evaluation(self, model, test, label=None, feature_names=None):
        from .plans.training import full_evaluation
        return full_evaluation(model, test, label or self.config.roles.target,
                               len(feature_names or []), self.config.key, feature_names)


class HousePricePredictor:
    """Scoring through one fitted PipelineModel: single = batch = stream."""

    def __init__(self, spark: SparkSession, model_path: str | None = None, model=None):
        self.spark = spark
        from .plans.stages import aligned
        found = model if model is not None else (md.load_model(model_path) if model_path else None)
        self.model = aligned(found) if found is not None else None

    def _require(self):
        if self.model is None:
            raise RuntimeError("no fitted model: pass one, or the path of a saved one")

    def predict_single(self, record: dict) -> dict:
        self._require()
        df = self.spark.createDataFrame([record])
        p = self.model.transform(df).select(F.col("prediction").alias("predicted"))
        r = ev.price_band(ev.clip_round_prediction(p, "predicted", "single")).first()
        return {"predicted_price": r["predicted"], "predicted_price_formatted": r["price_formatted"],
                "price_range": {"low": r["price_range"]["low_text"], "high": r["price_range"]["high_text"],
                                "lower_bound": r["price_range"]["low"], "upper_bound": r["price_range"]["high"]},
                "confidence": r["confidence"]}

    def predict_batch(self, df: DataFrame, output_path: str | None = None) -> DataFrame:
        self._require()
        return md.predict_batch(self.model, df, "PredictedPrice", output_path)

    def what_if_analysis(self, base: DataFrame, feature: str, values, key: str = "id") -> DataFrame:
        self._require()

        def score(frame):
            return self.model.transform(frame).withColumn("HedonicPrice", F.col("prediction"))
        return pr.what_if(base, feature, values, score, key)
