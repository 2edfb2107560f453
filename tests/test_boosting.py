"""Boosting from blocks of rows grows MLlib's trees."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from larkspur.operators import boosting as bo
from larkspur.operators import models as md


def _rows(spark, n=12_500, parts=3):
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(50, 20, n), "b": rng.integers(0, 3, n) * 1.0, "c": np.full(n, 7.0), "d": rng.integers(-4, 5, n) * 1.0, "e": np.zeros(n)}
    y = 3 * x["a"] + 40 * (x["b"] == 1) + x["d"] ** 2 + rng.normal(0, 5, n)
    df = spark.createDataFrame(pd.DataFrame(x | {"label": y})).repartition(parts, "a").cache()
    return VectorAssembler(inputCols=list(x), outputCol="features").transform(df)


def _numbers(text):
    return [float(v) for v in re.findall(r"-?\d+\.\d+(?:E-?\d+)?", text)]


@pytest.mark.parametrize("settings", [dict(maxIter=12, maxDepth=3, stepSize=0.1), dict(maxIter=3, maxDepth=5, stepSize=0.3, maxBins=256),
                                      dict(maxIter=2, maxDepth=4, minInstancesPerNode=900), dict(maxIter=2, maxDepth=0)])
def test_the_trees_of_mllib(spark, monkeypatch, tmp_path, settings):
    monkeypatch.setattr(bo, "ROWS_IN_BLOCKS", 1)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 1_000)
    df = _rows(spark)
    want, got = (kind(seed=42, labelCol="label", checkpointInterval=5, **settings).fit(df) for kind in (GBTRegressor, bo.BlockGBTRegressor))
    a, b = (m.toDebugString.split("\n")[1:] for m in (want, got))
    assert [re.sub(r"-?\d+\.\d+(E-?\d+)?", "#", x) for x in a] == [re.sub(r"-?\d+\.\d+(E-?\d+)?", "#", x) for x in b]
    assert all(np.allclose(_numbers(x), _numbers(y), rtol=1e-8, atol=1e-9) for x, y in zip(a, b))
    assert np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray()) and want.treeWeights == got.treeWeights
    assert np.allclose(want.evaluateEachIteration(df, "squared"), got.evaluateEachIteration(df, "squared"))
    got.write().overwrite().save(str(tmp_path / "m"))
    again = type(got).load(str(tmp_path / "m"))
    assert again.getMaxDepth() == settings["maxDepth"] and again.toDebugString == got.toDebugString


def test_pipelines_boost_from_blocks(spark, monkeypatch):
    assert all(isinstance(md.make_pipeline(name, ["a"]).getStages()[-1], bo.BlockGBTRegressor) for name in ("gradient_boosting", "xgboost"))
    monkeypatch.setattr(bo, "ROWS_IN_BLOCKS", 1)
    monkeypatch.setattr(bo.GBTRegressor, "_fit", lambda *_: pytest.fail("fitted by MLlib"))
    df = _rows(spark, 500, 2)
    assert md.make_estimator("xgboost", maxIter=2).fit(df).getNumTrees == 2
    for odd in (dict(subsamplingRate=0.5), dict(lossType="absolute"), dict(featureSubsetStrategy="0.8")):
        assert not bo._supported(bo.BlockGBTRegressor(**odd), df)


def test_rows_that_mllib_refuses(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(bo, "ROWS_IN_BLOCKS", 1)
    df = _rows(spark, 200, 2)
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        bo.BlockGBTRegressor(maxIter=1).fit(df.withColumn("label", F.when(F.col("b") > 0, F.col("label"))))
