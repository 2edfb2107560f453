import pandas as pd
from pyspark.sql import functions as F

from larkspur.operators import clean as cl
from larkspur.roles import HOUSING


def test_impute_no_nulls_left(spark, sample_df):
    dirty = sample_df.withColumn("GrLivArea", F.when(F.col("id") < 6, None).otherwise(F.col("GrLivArea"))) \
                     .withColumn("MSZoning", F.when(F.col("id").between(10, 15), None).otherwise(F.col("MSZoning")))
    model = cl.fit_imputer(dirty, HOUSING)
    out = model.transform(dirty)
    assert out.filter(F.col("GrLivArea").isNull() | F.col("MSZoning").isNull()).count() == 0
    assert out.count() == dirty.count()
    pdf = dirty.select("GrLivArea").toPandas()
    assert model.numeric_fill["GrLivArea"] == pdf["GrLivArea"].median()


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert cl.column_modes(df, ["c"]) == {"c": "a"}


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    from larkspur.roles import ColumnRoles
    m = cl.fit_imputer(df, ColumnRoles(numeric=("x", "y"), categorical=()))
    assert m.numeric_fill["x"] is None
    assert m.transform(df).filter(F.col("x").isNull()).count() == 2


def test_constants_first_flag(spark):
    df = spark.createDataFrame([(None, 5.0), (3.0, 7.0)], "PoolArea double, LotArea double")
    from larkspur.roles import ColumnRoles
    roles = ColumnRoles(numeric=("PoolArea", "LotArea"), categorical=())
    late = cl.fit_imputer(df, roles).transform(df).orderBy("LotArea").first()["PoolArea"]
    early = cl.fit_imputer(df, roles, constants_first=True).transform(df).orderBy("LotArea").first()["PoolArea"]
    assert late == 3.0 and early == 0.0


def test_iqr_removes_outlier(spark, sample_df):
    dirty = sample_df.withColumn("GrLivArea", F.when(F.col("id") == 0, 999999.0).otherwise(F.col("GrLivArea")))
    out = cl.remove_outliers_iqr(dirty)
    assert out.filter(F.col("GrLivArea") == 999999.0).count() == 0
    assert out.count() >= 0.8 * dirty.count()


def test_iqr_matches_sequential_pandas(spark, sample_df):
    out = cl.remove_outliers_iqr(sample_df, threshold=1.0)
    pdf = sample_df.toPandas()
    for c in HOUSING.outlier:
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        pdf = pdf[(pdf[c] >= q1 - (q3 - q1)) & (pdf[c] <= q3 + (q3 - q1))]
    assert sorted(r["id"] for r in out.select("id").collect()) == sorted(pdf["id"])


def test_zscore_keeps_fewer_or_equal(spark, sample_df):
    assert cl.remove_outliers_zscore(sample_df).count() <= sample_df.count()


def test_constant_column_and_empty(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "GrLivArea double")
    assert cl.remove_outliers_iqr(df).count() == 10          # IQR 0 keeps the constant
    assert cl.remove_outliers_zscore(df).count() == 0         # std 0: z undefined for every row
    empty = df.limit(0)
    assert cl.remove_outliers_iqr(empty).count() == 0
    assert cl.remove_outliers(df, method="unknown").count() == 10


def test_outlier_report(spark, sample_df):
    after = sample_df.limit(90)
    r = cl.outlier_report(sample_df, after).first()
    assert (r["rows_before"], r["rows_after"], r["rows_removed"]) == (100, 90, 10)
    assert r["pct_removed"] == 10.0


def test_range_validation(spark):
    df = spark.createDataFrame([(1, None, 11), (2, 100, 5)], "id long, LotArea long, OverallQual long")
    out = {r["id"]: r for r in cl.validate_ranges(df).collect()}
    assert out[1]["LotArea"] == 8500 and out[1]["violations"] == ["OverallQual"]
    assert out[2]["violations"] == ["LotArea"]


def test_normalize_na(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("Attchd", 1.0)], "g string, x double")
    out = cl.normalize_na(df).collect()
    assert out[0]["g"] is None and out[0]["x"] is None and out[1]["g"] == "Attchd"


def test_preprocess_makes_its_input_once(spark, sample_df):
    from larkspur.plans.training import preprocess
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            made.add(len(batch))
            yield batch

    n = sample_df.count()
    pre = preprocess(sample_df.mapInPandas(count, sample_df.schema))
    assert made.value == n and 0 < pre.data.count() <= n
