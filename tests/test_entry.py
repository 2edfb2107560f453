import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "Neighborhood" in df.columns
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_oracle_sample_at_smallest_scale(spark, sf_small):
    """A few registered queries against their DuckDB SQL at sf0.001."""
    import __spark_entry__ as e
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from oracle_check import digest
    con = duckdb.connect()
    from larkspur.sources.tables import TABLES
    for t in TABLES:
        p = os.path.join(sf_small, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    for name in ("hedonic_price", "target_encode", "outlier_iqr", "regression_metrics", "impute_mode"):
        df = e.queries()[name](spark, sf_small)
        rows = [tuple(r) for r in df.collect()]
        rel = con.sql(e.oracle_sql()[name])
        assert digest(df.columns, rows) == digest(list(rel.columns), rel.fetchall()), name
