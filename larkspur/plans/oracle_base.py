"""SQL twins of the derived fixture tables, for the DuckDB value oracle.

Fractional literals are written as DOUBLE: a bare ``1.2`` is DECIMAL in
DuckDB and would change the float arithmetic.
"""

from __future__ import annotations

LISTING_SQL = """
listing_j AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity,
         l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate,
         o.o_orderstatus, o.o_orderdate, o.o_orderpriority, c.c_acctbal, c.c_mktsegment,
         n.n_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
listing_s0 AS (
  SELECT *, CAST(year(o_orderdate) - 100 + round(l_quantity) AS INTEGER) AS yb FROM listing_j
),
listing_s1 AS (
  SELECT
    CAST(((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber AS BIGINT) AS id,
    CAST(floor(l_extendedprice / 4.0::DOUBLE) + 1300 AS BIGINT) AS LotArea,
    CAST(yb AS BIGINT) AS YearBuilt,
    CAST(CASE WHEN l_linenumber <= 3 THEN yb ELSE greatest(yb, year(l_shipdate) - 10) END AS BIGINT) AS YearRemodAdd,
    CAST(CASE WHEN p_size <= 4 THEN 0 ELSE p_size * 30 END AS BIGINT) AS TotalBsmtSF,
    CAST(floor(p_retailprice * 1.5::DOUBLE) + p_size * 10 AS BIGINT) AS GrLivArea,
    CAST(l_linenumber % 4 AS BIGINT) AS FullBath,
    CAST(l_linenumber % 3 AS BIGINT) AS HalfBath,
    CAST(l_linenumber AS BIGINT) AS BedroomAbvGr,
    CAST(l_linenumber + 3 AS BIGINT) AS TotRmsAbvGrd,
    CAST(floor(greatest(c_acctbal, 0.0::DOUBLE) / 8.0::DOUBLE) AS BIGINT) AS GarageArea,
    CAST(CASE WHEN l_quantity > 47 THEN 500 ELSE 0 END AS BIGINT) AS PoolArea,
    CAST(CAST(round(l_discount * 100.0::DOUBLE) AS INTEGER) % 10 + 1 AS BIGINT) AS OverallQual,
    CAST(CAST(round(l_tax * 100.0::DOUBLE) AS INTEGER) + 1 AS BIGINT) AS OverallCond,
    c_mktsegment AS MSZoning,
    l_returnflag AS Street,
    o_orderstatus AS LotShape,
    l_linestatus AS Utilities,
    n_name AS Neighborhood,
    p_type AS BldgType,
    p_brand AS HouseStyle,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Ex' WHEN '2' THEN 'Gd' WHEN '3' THEN 'TA'
         WHEN '4' THEN 'Fa' ELSE 'Po' END AS ExterQual
  FROM listing_s0
),
listing_s2 AS (
  SELECT *,
    (40000.0::DOUBLE
      + exp(0.28::DOUBLE * OverallQual) * 8500
      + OverallCond * 2000
      + GrLivArea * 62
      + TotalBsmtSF * 18
      + GarageArea * 28
      + LotArea * 1.2::DOUBLE
      + (YearBuilt - 1872) * 280
      + (YearRemodAdd - YearBuilt) * 150
      + FullBath * 6000
      + HalfBath * 3000
      + CASE WHEN PoolArea > 0 THEN 5000 + PoolArea * 40 ELSE 0 END)
    * CASE ExterQual WHEN 'Ex' THEN 1.15::DOUBLE WHEN 'Gd' THEN 1.06::DOUBLE WHEN 'TA' THEN 1.0::DOUBLE
                     WHEN 'Fa' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
    * (0.93::DOUBLE + ((id * 7919) % 1000) * 0.00014::DOUBLE) AS raw_price
  FROM listing_s1
),
listing_s3 AS (
  SELECT *, CAST(floor(least(greatest(raw_price, 34900.0::DOUBLE), 755000.0::DOUBLE)) AS BIGINT) + 50 AS sp
  FROM listing_s2
),
listing AS (
  SELECT id, LotArea, YearBuilt, YearRemodAdd, TotalBsmtSF, GrLivArea, FullBath, HalfBath,
         BedroomAbvGr, TotRmsAbvGrd, GarageArea, PoolArea, OverallQual, OverallCond,
         MSZoning, Street, LotShape, Utilities, Neighborhood, BldgType, HouseStyle, ExterQual,
         CAST(sp - (sp % 100) AS BIGINT) AS SalePrice
  FROM listing_s3
)"""

DIRTY_LISTING_SQL = LISTING_SQL + """,
dirty_base AS (
  SELECT id,
    CASE WHEN id % 17 = 0 THEN NULL ELSE LotArea END AS LotArea,
    YearBuilt, YearRemodAdd, TotalBsmtSF,
    CASE WHEN id % 17 = 0 THEN NULL
         WHEN (id // 160000000) % 97 = 0 THEN GrLivArea * 20 ELSE GrLivArea END AS GrLivArea,
    FullBath, HalfBath, BedroomAbvGr, TotRmsAbvGrd, GarageArea, PoolArea, OverallQual, OverallCond,
    CASE WHEN id % 23 = 0 THEN NULL ELSE MSZoning END AS MSZoning,
    Street, LotShape, Utilities, Neighborhood, BldgType, HouseStyle,
    CASE WHEN id % 23 = 0 THEN NULL ELSE ExterQual END AS ExterQual,
    SalePrice
  FROM listing
),
dirty_listing AS (
  SELECT * FROM dirty_base
  UNION ALL
  SELECT * FROM dirty_base WHERE id % 101 = 0
)"""


def with_listing(body: str) -> str:
    return f"WITH {LISTING_SQL}\n{body}"


def with_dirty_listing(body: str) -> str:
    return f"WITH {DIRTY_LISTING_SQL}\n{body}"
