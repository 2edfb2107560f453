import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larkspur.functions.moments import sample_kurtosis, sample_skewness
from larkspur.operators import profile as pf
from larkspur.operators.quantiles import exact_quantiles


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.lognormal(3, 1, 5000), 1)
    y = rng.integers(0, 7, 5000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for parts in (1, 23):                # one range and many
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        q = exact_quantiles(df, ["x", "y"], probs)
        for c, arr in (("x", x), ("y", y)):
            ref = pd.Series(arr).quantile(probs).values
            assert np.allclose(q[c], ref, rtol=0, atol=1e-9), (parts, c)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    many = [i / 99 for i in range(100)]
    q = exact_quantiles(df, ["x"], many)
    assert np.allclose(q["x"], pd.Series(x).quantile(many).values, atol=1e-9)


def test_quantiles_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])["v"] == [2.0]
    assert exact_quantiles(df.filter("v > 10"), ["v"], [0.5])["v"] == [None]


def test_corrected_moments_match_pandas(spark):
    rng = np.random.default_rng(2)
    v = rng.gamma(2.0, 3.0, 3000)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    r = df.agg(sample_skewness("v").alias("s"), sample_kurtosis("v").alias("k")).first()
    assert math.isclose(r["s"], pd.Series(v).skew(), rel_tol=1e-9)
    assert math.isclose(r["k"], pd.Series(v).kurt(), rel_tol=1e-9)
    few = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert few.agg(sample_skewness("v")).first()[0] is None     # n < 3


def test_describe_and_reports(spark, sample_df):
    d = {r["column"]: r for r in pf.numeric_describe(sample_df, ["GrLivArea"]).collect()}
    ref = sample_df.select("GrLivArea").toPandas()["GrLivArea"].describe()
    assert math.isclose(d["GrLivArea"]["std"], ref["std"]) and d["GrLivArea"]["q25"] == ref["25%"]
    dup = sample_df.unionByName(sample_df.limit(3))
    assert pf.duplicate_count(dup).first()["duplicates"] == 3
    miss = pf.missing_report(sample_df.withColumn("z", F.lit(None).cast("double")))
    assert [r["column"] for r in miss.collect()] == ["z"]
    vc = pf.value_counts_top(sample_df, "Neighborhood", 2).collect()
    assert len(vc) == 2 and vc[0]["count"] >= vc[1]["count"]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 2000)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    h = [r["count"] for r in pf.histogram(df, "v", 50).collect()]
    assert h == list(np.histogram(v, 50)[0])
    const = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert [r["count"] for r in pf.histogram(const, "v", 50).collect()] == [5]


def test_boxplot_and_corr(spark, sample_df):
    b = pf.boxplot_stats(sample_df, "SalePrice", "ExterQual").collect()
    assert sum(r["n"] for r in b) == 100
    c = pf.corr_with_target(sample_df.select("GrLivArea", "LotArea", "SalePrice")).collect()
    assert c[0]["column"] == "SalePrice" and math.isclose(c[0]["corr"], 1.0)
    m = pf.corr_matrix_top(sample_df.select("GrLivArea", "LotArea", "SalePrice"), top_n=3).collect()
    assert len(m) == 3


def test_corr_matrix_in_parts(spark, monkeypatch):
    """All pairs, pairwise without NULLs, none of the aggregations with more than a few of them."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({f"c{i}": rng.normal(0, 1, 60) for i in range(7)})
    frame["SalePrice"] = frame.sum(axis=1)
    frame.loc[::4, "c1"] = None
    frame.loc[1::5, "c2"] = None
    df = spark.createDataFrame(frame).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame.columns])
    sizes, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *e: sizes.append(len(e)) or agg(self, *e))
    found = {frozenset((r["col_i"], r["col_j"])): r["corr"] for r in pf.corr_matrix_top(df).collect()}
    want = frame.corr()
    assert len(found) == 28
    assert all(math.isclose(v, want.loc[tuple(k)], abs_tol=1e-9) for k, v in found.items())
    assert max(sizes) <= 15
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(df._jdf).isDefined()
