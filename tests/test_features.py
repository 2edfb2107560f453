import math

from pyspark.sql import functions as F

from larkspur.operators import features as fe

SAMPLE_HOUSE = dict(LotArea=8500, YearBuilt=2005, YearRemodAdd=2015, TotalBsmtSF=1000.0, GrLivArea=1800.0,
                    FullBath=2, HalfBath=1, BedroomAbvGr=3, TotRmsAbvGrd=7, GarageArea=400.0, PoolArea=0.0,
                    OverallQual=7, OverallCond=5)


def _one(spark, **kw):
    row = dict(SAMPLE_HOUSE, **kw)
    return spark.createDataFrame([tuple(row.values())], list(row.keys()))


def test_golden_values(spark):
    r = fe.derive(_one(spark)).first()
    assert r["HouseAge"] == 19
    assert r["TotalSF"] == 2800
    assert r["TotalBathrooms"] == 2.5
    assert r["QualityScore"] == 35
    assert r["RemodelAge"] == 10 and r["IsRemodeled"] == 1 and r["YearsAfterRemodel"] == 9
    assert r["HasPool"] == 0 and r["HasGarage"] == 1 and r["IsHighQuality"] == 0
    assert math.isclose(r["LotAreaPerRoom"], 8500 / 8)
    assert math.isclose(r["AreaPerBath"], 1800 / 3.5)
    assert math.isclose(r["QualCondRatio"], 7 / 6)


def test_presence_guards(spark):
    df = _one(spark).drop("YearRemodAdd", "HalfBath", "OverallCond")
    cols = fe.derive(df).columns
    assert "HouseAge" in cols and "RemodelAge" not in cols and "QualityScore" not in cols
    r = fe.derive(df).first()
    assert r["TotalBathrooms"] == 2.0      # only the parts that exist


def test_nulls_and_zero_division(spark):
    df = spark.createDataFrame([(None, 500.0, -1, 10000, 2, 1)],
                               "GrLivArea double, TotalBsmtSF double, TotRmsAbvGrd int, LotArea long, "
                               "FullBath int, HalfBath int")
    r = fe.derive(df).first()
    assert r["TotalSF"] == 500.0           # NULL skipped in the row sum
    assert r["LotAreaPerRoom"] is None     # x / 0 -> NULL, no error
    assert r["AreaPerBath"] is None        # NULL propagates
    df2 = spark.createDataFrame([(None, None)], "YearBuilt long, YearRemodAdd long")
    assert fe.derive(df2).first()["IsRemodeled"] == 0


def test_subset_derivations(spark):
    single = fe.derive(_one(spark), only=fe.SINGLE_RECORD_FEATURES)
    assert set(fe.SINGLE_RECORD_FEATURES) <= set(single.columns)
    assert "AreaPerBath" not in single.columns
    batch = fe.derive(_one(spark), only=fe.BATCH_FEATURES)
    assert [c for c in batch.columns if c not in SAMPLE_HOUSE] == list(fe.BATCH_FEATURES)


def test_align_features(spark):
    out = fe.align_features(_one(spark), ["GrLivArea", "Missing", "OverallQual"])
    assert out.columns == ["GrLivArea", "Missing", "OverallQual"]
    assert out.first()["Missing"] == 0.0


def test_target_encoder_default_is_mean_of_means(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", 4.0), ("a", 4.0), ("b", 10.0), (None, 100.0)], "k string, y double")
    enc = fe.fit_target_encoder(df, "k", "y", "enc")
    assert math.isclose(enc.default, 7.0)   # unweighted mean of the group means, NULL key ignored
    test = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    vals = sorted((r["k"] or "", r["enc"]) for r in enc.transform(test).collect())
    assert vals == [("", 7.0), ("a", 4.0), ("c", 7.0)]


def test_target_encoder_no_key_column(spark):
    df = spark.createDataFrame([(1.0,)], "y double")
    enc = fe.fit_target_encoder(df, "k", "y")
    assert enc.transform(df).columns == ["y"]


def test_log_transform_given_and_auto(spark):
    df = spark.createDataFrame([(float(i ** 3), float(i) - 5.0, 1.0) for i in range(1, 40)], "a double, b double, c double")
    m = fe.fit_log_transform(df, ["a", "b", "missing"])
    assert m.columns == ["a"]              # b has a negative minimum
    auto = fe.fit_log_transform(df, None, target="zzz")
    assert auto.columns == ["a"]           # skewed, non-negative; constant c has skew 0
    out = m.transform(df).first()
    assert math.isclose(out["a_log"], math.log1p(1.0))


def test_feature_engineer_end_to_end(spark, sample_df):
    model = fe.fit_feature_engineer(sample_df, "SalePrice")
    out = model.transform(sample_df)
    assert "NeighborhoodAvgPrice" in out.columns and "HouseAge" in out.columns
    assert out.count() == sample_df.count()
    assert out.filter(F.col("NeighborhoodAvgPrice").isNull()).count() == 0
