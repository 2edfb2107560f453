"""One key holds a third of all rows: results stay exact and whole."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larkspur.operators import clean as cl
from larkspur.operators import features as fe
from larkspur.operators import profile as pf
from larkspur.operators.quantiles import exact_quantiles
from larkspur.operators.split import assign_split_exact


def _skewed(spark, n=30000):
    rng = np.random.default_rng(7)
    hot = n // 3
    keys = np.array(["HOT"] * hot + [f"k{i % 500}" for i in range(n - hot)])
    price = np.where(keys == "HOT", 100000.0, rng.integers(50, 5000, n) * 100.0)
    area = np.where(np.arange(n) < hot, 1500.0, rng.normal(1500, 300, n).round(1))
    pdf = pd.DataFrame({"id": np.arange(n), "Neighborhood": keys, "SalePrice": price, "GrLivArea": area})
    return spark.createDataFrame(pdf).repartition(8), pdf


def test_hot_key_operators(spark):
    df, pdf = _skewed(spark)
    # target encoding: group means, mean of means
    enc = fe.fit_target_encoder(df, "Neighborhood", "SalePrice", "enc")
    means = pdf.groupby("Neighborhood")["SalePrice"].mean()
    assert abs(enc.default - means.mean()) < 1e-6
    got = {r["Neighborhood"]: r["enc"] for r in enc.transform(df).select("Neighborhood", "enc").distinct().collect()}
    assert got["HOT"] == 100000.0 and len(got) == len(means)
    # mode with a third of the rows on one value
    assert cl.column_modes(df, ["Neighborhood"]) == {"Neighborhood": "HOT"}
    # exact quantiles where one value fills a third of the column
    probs = [0.1, 0.3, 0.5, 0.9]
    q = exact_quantiles(df, ["GrLivArea"], probs)["GrLivArea"]
    assert np.allclose(q, pdf["GrLivArea"].quantile(probs).values, atol=1e-9)
    # grouped report keeps every group, including the hot one
    box = {r["Neighborhood"]: r for r in pf.boxplot_stats(df, "SalePrice", "Neighborhood").collect()}
    assert box["HOT"]["n"] == len(pdf) // 3 and len(box) == pdf["Neighborhood"].nunique()
    # duplicates: the hot rows differ by id, so none are duplicates
    assert pf.duplicate_count(df).first()["duplicates"] == 0
    assert pf.duplicate_count(df.drop("id")).first()["duplicates"] == \
        int(pdf.drop(columns="id").duplicated().sum())
    # exact split size does not depend on the hot group
    s = assign_split_exact(df)
    assert s.filter(F.col("split") == "test").count() == round(0.2 * len(pdf))
    # no rows dropped anywhere
    assert enc.transform(df).count() == len(pdf)
