from pyspark.sql import functions as F

from larkspur import api
from larkspur.operators import models as md


def test_predictor_single_batch_whatif(spark, sample_df):
    feats = ["GrLivArea", "OverallQual", "LotArea"]
    data = sample_df.withColumn("label", F.col("SalePrice").cast("double"))
    model = md.make_pipeline("linear_regression", feats).fit(data)
    pred = api.HousePricePredictor(spark, model=model)
    rec = {"GrLivArea": 1800.0, "OverallQual": 7, "LotArea": 8500}
    out = pred.predict_single(rec)
    assert set(out) == {"predicted_price", "predicted_price_formatted", "price_range", "confidence"}
    assert out["predicted_price"] >= 0 and out["predicted_price_formatted"].startswith("$")
    assert out["price_range"]["lower_bound"] <= out["price_range"]["upper_bound"]
    batch = pred.predict_batch(sample_df.select("id", *feats))
    assert batch.columns == ["id", *feats, "PredictedPrice"] and batch.count() == 100
    wi = pred.what_if_analysis(sample_df.select("id", *feats).limit(2), "OverallQual", [3, 9])
    assert wi.count() == 4


def test_predictor_requires_model(spark):
    import pytest
    with pytest.raises(RuntimeError):
        api.HousePricePredictor(spark).predict_single({"GrLivArea": 1.0})


def test_facade_pipeline(spark, sample_df):
    pre = api.DataPreprocessor()
    train, test = pre.run_pipeline(sample_df)
    assert train.count() + test.count() <= 100
    assert all(t != "string" for _, t in train.dtypes)
    eng = api.FeatureEngineer()
    assert "HouseAge" in eng.run_all(sample_df).columns


def test_end_to_end_artifact_scores_raw_rows(spark, sample_df, tmp_path):
    """M22 + S5/S6: the saved artifact holds every fitted step, so it scores
    raw (unprocessed) rows after a reload."""
    from larkspur.plans.training import train_end_to_end
    raw = sample_df.withColumn("GrLivArea", F.when(F.col("id") < 3, None).otherwise(F.col("GrLivArea")))
    path = str(tmp_path / "best")
    results, best, full, _ = train_end_to_end(raw, names=("linear_regression", "decision_tree"), model_path=path)
    assert results.count() == 2 and best in ("linear_regression", "decision_tree")
    again = md.load_model(path)
    a = full.transform(raw.drop("SalePrice")).select("id", "prediction").orderBy("id").collect()
    b = again.transform(raw.drop("SalePrice")).select("id", "prediction").orderBy("id").collect()
    assert len(a) == 100 and a == b


def test_records_with_absent_and_extra_fields(spark, sample_df, tmp_path):
    """Three fields and an unknown one score alike, one by one, in a
    batch, and after a reload; absent features are 0."""
    from larkspur.plans import training as tr
    data = sample_df.withColumn("label", F.col("SalePrice").cast("double"))
    feats = ["GrLivArea", "OverallQual", "LotArea", "HouseAge"]
    model = md.make_pipeline("linear_regression", feats).fit(data.withColumn("HouseAge", 2024 - F.col("YearBuilt")))
    coef, intercept = md.linear_coefficients(model)
    pred = api.HousePricePredictor(spark, model=model)
    batch = pred.predict_batch(sample_df.select("id", "GrLivArea", "OverallQual", "YearBuilt", "Street")).collect()
    for r in batch[:5]:
        want = intercept + coef[0] * r.GrLivArea + coef[1] * r.OverallQual + coef[3] * (2024 - r.YearBuilt)
        single = pred.predict_single({"GrLivArea": r.GrLivArea, "OverallQual": r.OverallQual, "YearBuilt": r.YearBuilt, "Street": "x"})
        assert abs(single["predicted_price"] - max(want, 0)) < 0.01 and abs(r.PredictedPrice - max(want, 0)) < 0.01
    scaled = tr.scaled_pipeline(data, "ridge", ("GrLivArea", "OverallQual", "LotArea"))
    again = md.load_model(md.save_model(scaled, str(tmp_path / "scaled")))
    few = sample_df.select("id", "OverallQual", "Street")
    assert again.transform(few).select("id", "prediction").collect() == scaled.transform(few).select("id", "prediction").collect()


def test_fallbacks_for_absent_source_and_model(spark, sample_df, tmp_path):
    from larkspur.sources import files
    config = api.Config(raw_data_path=str(tmp_path / "absent.csv"), model_path=str(tmp_path / "model"), cv_splits=2,
                        models=("linear_regression", "ridge"))
    loader = api.DataLoader(spark, config)
    got = loader.load_data("id long, GrLivArea double, Street string", fallback=lambda: sample_df)
    assert got.columns == ["id", "GrLivArea", "Street"] and got.count() == 100
    files.write_csv(sample_df.select("id", "Street").limit(7), config.raw_data_path)
    assert loader.load_data("id long, Street string", fallback=lambda: sample_df).count() == 7
    trainer = api.ModelTrainer(config)
    model = trainer.load_or_train(sample_df)
    again = trainer.load_or_train(sample_df.limit(0))
    raw = sample_df.drop("SalePrice")
    assert model.transform(raw).select("id", "prediction").collect() == again.transform(raw).select("id", "prediction").collect()
