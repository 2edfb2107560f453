import datetime
import math

from larkspur.sources.listing import listing


def _tables(spark, folder, order_keys):
    """One line item for each order key, in tables of their own."""
    day = datetime.datetime(1996, 5, 17)
    rows = {
        "nation": ("n_nationkey int, n_name string", [(1, "PERU")]),
        "customer": ("c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string", [(3, 1, 800.0, "BUILDING")]),
        "part": ("p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double", [(7, "Brand#11", "TIN", 10, 900.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string",
                   [(k, 3, "O", day, "3-MEDIUM") for k in order_keys]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(k, 7, 5, 1, 20.0, 8000.0, 0.04, 0.02, "N", "O", day) for k in order_keys]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_price_with_large_order_keys(spark, tmp_path):
    keys = [1, 149_999, 7_279_000, 9_000_001, 50_000_000]
    found = {r["id"]: r for r in listing(spark, _tables(spark, tmp_path, keys)).collect()}
    assert len(found) == len(keys)
    for k in keys:
        ident = ((k * 20000 + 7) * 1000 + 5) * 8 + 1
        base = 40000 + math.exp(0.28 * 5) * 8500 + 3 * 2000 + 1450 * 62 + 300 * 18 + 100 * 28 + 3300 * 1.2
        built = 1996 - 100 + 20
        raw = (base + (built - 1872) * 280 + 6000 + 3000) * (0.93 + ident * 7919 % 1000 * 0.00014)
        whole = math.floor(raw) + 50
        assert found[ident]["SalePrice"] == whole - whole % 100
