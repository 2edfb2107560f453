"""Physical-plan properties: no Python evaluation anywhere in the SQL-checked
queries, pruned scans, no cartesian products, broadcast only behind checks."""

import re

import pytest

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def catalog():
    from larkspur.plans.catalog import oracle_sql, queries
    return queries(), oracle_sql()


@pytest.mark.parametrize("name", ["age_features", "area_features", "hedonic_price", "target_encode",
                                  "what_if", "residuals", "hash_split", "encode_categoricals",
                                  "json_score_response", "duplicate_count", "bootstrap_ci"])
def test_no_python_in_plan(spark, sf_small, catalog, name):
    plan = _plan(catalog[0][name](spark, sf_small))
    assert not any(n in plan for n in PY_NODES), name
    assert "CartesianProduct" not in plan


def test_scan_is_pruned(spark, sf_small, catalog):
    plan = _plan(catalog[0]["age_features"](spark, sf_small))
    schema = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", plan)
    assert schema is not None
    cols = {c.split("#")[0] for c in schema.group(1).split(",")}
    # only keys and the columns the age features need are read
    assert "l_extendedprice" not in cols and "l_returnflag" not in cols
    assert {"l_orderkey", "l_partkey", "l_linenumber"} <= cols


def test_every_oracle_query_has_a_spark_twin(catalog):
    q, o = catalog
    assert set(o) <= set(q)


def test_cross_validate_runs_every_model(spark, sf_small, monkeypatch):
    from larkspur.operators import models as md
    from larkspur.plans import q_models as qm
    asked = []

    def noted(df, features, label, names=(), k=0, **kw):
        asked.append((names, k))
        return spark.createDataFrame([(n, i, 0.5, 0.1) for i, n in enumerate(names, 1)], "model string, ordinal int, cv_mean double, cv_std double")

    monkeypatch.setattr(md, "cross_validate", noted)
    out = qm.cross_validate(spark, sf_small)
    assert asked == [(md.MODEL_ORDER, 5)] and [r["model"] for r in out.orderBy("ordinal").collect()] == list(md.MODEL_ORDER)
