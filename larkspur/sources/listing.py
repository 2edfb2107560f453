"""``listing``: a housing-shaped table at line-item grain, derived by Spark
from the star-schema tables (lineitem -> orders -> customer -> nation and
lineitem -> part). Its work grows with the input tables.

The column formulas are fixed so that the same table can be rebuilt in any
SQL engine (see ``plans.oracle.LISTING_SQL``) for value-level checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import EXTER_MULT, base_price, multiplier, with_clip_round_price
from .tables import broadcast_if_small, read_table

# ExterQual from the first character of o_orderpriority.
PRIORITY_TO_QUALITY = {"1": "Ex", "2": "Gd", "3": "TA", "4": "Fa"}
# Price noise multiplier parameters.
NOISE_BASE, NOISE_MULT, NOISE_MOD, NOISE_STEP = 0.93, 7919, 1000, 0.00014


def _joined(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    l = (lineitem if lineitem is not None else read_table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    # Join order chosen for scale: customer (+ the tiny, size-checked nation)
    # joins orders at order grain first, so line-item-grain rows are shuffled
    # only twice (by order key, then by part key) instead of three times.
    # Large joins are left to Catalyst/AQE: sort-merge with skew splitting,
    # or broadcast when runtime statistics prove a side small.
    cn = c.join(broadcast_if_small(n), c.c_nationkey == n.n_nationkey)
    ocn = o.join(cn, o.o_custkey == cn.c_custkey)
    return (l.join(ocn, l.l_orderkey == ocn.o_orderkey)
             .join(p, l.l_partkey == p.p_partkey))


def listing(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """``lineitem`` may be a streaming frame: the other tables then join as
    static sides (stream-static inner joins)."""
    c = F.col
    j = _joined(spark, sf_dir, lineitem)
    ident = (((c("l_orderkey") * 20000 + c("l_partkey")) * 1000 + c("l_suppkey")) * 8
             + c("l_linenumber")).cast("long")
    year_built = (F.year("o_orderdate") - 100 + F.round("l_quantity")).cast("int")
    stage1 = j.select(
        ident.alias("id"),
        (F.floor(c("l_extendedprice") / 4) + 1300).cast("long").alias("LotArea"),
        year_built.cast("long").alias("YearBuilt"),
        F.when(c("l_linenumber") <= 3, year_built)
         .otherwise(F.greatest(year_built, F.year("l_shipdate") - 10)).cast("long").alias("YearRemodAdd"),
        F.when(c("p_size") <= 4, F.lit(0)).otherwise(c("p_size") * 30).cast("long").alias("TotalBsmtSF"),
        (F.floor(c("p_retailprice") * 1.5) + c("p_size") * 10).cast("long").alias("GrLivArea"),
        (c("l_linenumber") % 4).cast("long").alias("FullBath"),
        (c("l_linenumber") % 3).cast("long").alias("HalfBath"),
        c("l_linenumber").cast("long").alias("BedroomAbvGr"),
        (c("l_linenumber") + 3).cast("long").alias("TotRmsAbvGrd"),
        F.floor(F.greatest(c("c_acctbal"), F.lit(0.0)) / 8).cast("long").alias("GarageArea"),
        F.when(c("l_quantity") > 47, F.lit(500)).otherwise(F.lit(0)).cast("long").alias("PoolArea"),
        ((F.round(c("l_discount") * 100).cast("int") % 10) + 1).cast("long").alias("OverallQual"),
        (F.round(c("l_tax") * 100).cast("int") + 1).cast("long").alias("OverallCond"),
        c("c_mktsegment").alias("MSZoning"),
        c("l_returnflag").alias("Street"),
        c("o_orderstatus").alias("LotShape"),
        c("l_linestatus").alias("Utilities"),
        c("n_name").alias("Neighborhood"),
        c("p_type").alias("BldgType"),
        c("p_brand").alias("HouseStyle"),
        F.coalesce(
            F.try_element_at(F.create_map(*[x for k, v in PRIORITY_TO_QUALITY.items()
                                        for x in (F.lit(k), F.lit(v))]),
                         F.substring("o_orderpriority", 1, 1)),
            F.lit("Po")).alias("ExterQual"),
    )
    # the remainder first: id * NOISE_MULT leaves the range of a long from an order key of 7.3 million on
    noise = F.lit(NOISE_BASE) + F.pmod(F.pmod(c("id"), F.lit(NOISE_MOD)) * NOISE_MULT, F.lit(NOISE_MOD)) * NOISE_STEP
    raw = base_price() * multiplier("ExterQual", EXTER_MULT, 1.0) * noise
    return with_clip_round_price(stage1, raw, "SalePrice")


# Dirt injected for the cleaning operators (same arithmetic in the SQL twin).
NULL_NUMERIC_MOD, NULL_CATEGORY_MOD, OUTLIER_ORDER_MOD, OUTLIER_FACTOR, DUP_MOD = 17, 23, 97, 20, 101
NULL_NUMERIC_COLS = ("GrLivArea", "LotArea")
NULL_CATEGORY_COLS = ("MSZoning", "ExterQual")


def dirty_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``listing`` with NULLs, size outliers and exact duplicate rows."""
    base = listing(spark, sf_dir)
    c = F.col
    cols = []
    for name in base.columns:
        e = c(name)
        if name == "GrLivArea":
            # outliers first: the order key is recovered from the id
            e = F.when(F.pmod(F.floor(c("id") / 160000000), F.lit(OUTLIER_ORDER_MOD)) == 0,
                       e * OUTLIER_FACTOR).otherwise(e)
        if name in NULL_NUMERIC_COLS:
            e = F.when(F.pmod(c("id"), F.lit(NULL_NUMERIC_MOD)) == 0, F.lit(None)).otherwise(e)
        if name in NULL_CATEGORY_COLS:
            e = F.when(F.pmod(c("id"), F.lit(NULL_CATEGORY_MOD)) == 0, F.lit(None)).otherwise(e)
        cols.append(e.cast(base.schema[name].dataType).alias(name))
    # exact duplicates: a row with id % DUP_MOD == 0 is emitted twice, in the
    # same pass (no second evaluation of the join, as a union would need)
    copies = F.when(F.pmod(c("id"), F.lit(DUP_MOD)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.select(*cols, F.explode(copies).alias("_copy")).drop("_copy")
