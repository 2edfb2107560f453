import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import encode as en
from larkspur.operators.split import assign_folds, assign_split, train_test_split, with_curve_share
from larkspur.roles import string_columns


def test_ordinal_unknown_and_null(spark):
    df = spark.createDataFrame([("Ex",), ("Po",), ("zz",), (None,)], "ExterQual string")
    assert [r[0] for r in en.ordinal_encode(df).collect()] == [5, 1, 3, 3]


def test_encode_leaves_no_text(spark, sample_df):
    m = en.fit_categorical_encoder(sample_df)
    out = m.transform(sample_df)
    assert string_columns(out) == []
    assert len(out.columns) > len(sample_df.columns)


def test_one_hot_drop_first_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "z string")
    m = en.fit_one_hot(df, ["z"])
    assert m.dummy_names() == ["z_b", "z_c"]
    new = spark.createDataFrame([("d",), (None,), ("c",)], "z string")
    rows = [tuple(r) for r in m.transform(new).collect()]
    assert rows == [(0, 0), (0, 0), (0, 1)]


def test_one_hot_category_cap(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("z"))
    with pytest.raises(ValueError):
        en.fit_one_hot(df, ["z"], max_categories=10)


def test_robust_scaler_matches_formula_and_iqr0(spark, sample_df):
    m = en.fit_robust_scaler(sample_df, ["GrLivArea", "PoolArea"])
    pdf = sample_df.select("GrLivArea").toPandas()["GrLivArea"]
    assert m.center["GrLivArea"] == pdf.median()
    assert m.scale["GrLivArea"] == pdf.quantile(0.75) - pdf.quantile(0.25)
    assert m.scale["PoolArea"] == 1.0          # IQR 0 -> divide by 1, values stay (x - median)
    out = m.transform(sample_df).agg(F.max("PoolArea")).first()[0]
    assert out == 0.0


def test_split_ratio_overlap_and_determinism(spark, sample_df):
    big = spark.range(20000).withColumnRenamed("id", "id")
    s = assign_split(big)
    share = s.filter(F.col("split") == "test").count() / 20000
    assert abs(share - 0.2) < 0.02
    again = assign_split(big.repartition(7))
    a = {r["id"]: r["split"] for r in s.collect()}
    b = {r["id"]: r["split"] for r in again.collect()}
    assert a == b                              # independent of partitioning
    tr, te = train_test_split(sample_df)
    ids_tr = {r["id"] for r in tr.select("id").collect()}
    ids_te = {r["id"] for r in te.select("id").collect()}
    assert not (ids_tr & ids_te) and len(ids_tr) + len(ids_te) == 100


def test_string_key_split(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(2000)], "key string")
    s = assign_split(df, "key")
    assert 300 < s.filter(F.col("split") == "test").count() < 500


def test_folds_and_learning_curve(spark):
    df = spark.range(10000)
    f = assign_folds(df, k=5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [0, 1, 2, 3, 4]
    assert all(1700 < r["count"] < 2300 for r in f)
    shared = with_curve_share(df)
    counts = [shared.filter(F.col("curve_share") < f / 10).count() for f in range(1, 11)]
    assert counts == sorted(counts) and counts[-1] == 10000   # nested, full at 100 %
    assert abs(counts[4] - 5000) < 300


def test_exact_split_size(spark):
    from larkspur.operators.split import assign_split_exact
    df = spark.range(12345)
    for fanout in (4096, 2):          # few passes and one per bit
        for share in (0.2, 0.33337, 0.0, 1.0):
            s = assign_split_exact(df, test_share=share, fanout=fanout)
            assert s.filter(F.col("split") == "test").count() == round(share * 12345)
    s1 = {r["id"] for r in assign_split_exact(df).filter("split = 'test'").collect()}
    s2 = {r["id"] for r in assign_split_exact(df.repartition(5)).filter("split = 'test'").collect()}
    assert s1 == s2
