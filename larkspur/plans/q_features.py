"""Queries: derived columns, log transforms, target encoding, lookups,
alignment, pricing, what-if (P2-P26, J1-J4, T7, M18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket_sql
from ..operators import features as fe
from ..operators import pricing as pr
from ..operators.split import assign_split
from ..sources.listing import listing
from .oracle_base import with_listing
from .registry import register

R6 = 6  # decimals for doubles computed by different float routines


def _r(c, k=R6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


@register("age_features", "P2 P3 P4 P5 P14", with_listing("""
SELECT id, 2024 - YearBuilt AS HouseAge, YearRemodAdd - YearBuilt AS RemodelAge,
       CAST(CASE WHEN YearRemodAdd - YearBuilt > 0 THEN 1 ELSE 0 END AS INTEGER) AS IsRemodeled,
       2024 - YearRemodAdd AS YearsAfterRemodel
FROM listing"""))
def age_features(spark, sf):
    df = listing(spark, sf)
    return fe.add_age_features(df).select("id", *fe.AGE_FEATURES)


AREA_SQL = """
  coalesce(CAST(GrLivArea AS DOUBLE), 0.0::DOUBLE) + coalesce(CAST(TotalBsmtSF AS DOUBLE), 0.0::DOUBLE) AS TotalSF,
  CAST(FullBath AS DOUBLE) + HalfBath * 0.5::DOUBLE AS TotalBathrooms,
  CAST(CASE WHEN PoolArea > 0 THEN 1 ELSE 0 END AS INTEGER) AS HasPool,
  CAST(CASE WHEN GarageArea > 0 THEN 1 ELSE 0 END AS INTEGER) AS HasGarage,
  CASE WHEN TotRmsAbvGrd + 1 = 0 THEN NULL ELSE CAST(LotArea AS DOUBLE) / CAST(TotRmsAbvGrd + 1 AS DOUBLE) END AS LotAreaPerRoom,
  CAST(GrLivArea AS DOUBLE) / (CAST(FullBath AS DOUBLE) + HalfBath * 0.5::DOUBLE + 1.0::DOUBLE) AS AreaPerBath"""


@register("area_features", "P6 P7 P8 P9 P10 P14", with_listing(f"SELECT id, {AREA_SQL}\nFROM listing"))
def area_features(spark, sf):
    df = listing(spark, sf)
    return fe.add_area_features(df).select("id", *fe.AREA_FEATURES)


@register("quality_features", "P11 P12 P13", with_listing("""
SELECT id, OverallQual * OverallCond AS QualityScore,
       CAST(OverallQual AS DOUBLE) / CAST(OverallCond + 1 AS DOUBLE) AS QualCondRatio,
       CAST(CASE WHEN OverallQual >= 8 THEN 1 ELSE 0 END AS INTEGER) AS IsHighQuality
FROM listing"""))
def quality_features(spark, sf):
    df = listing(spark, sf)
    return fe.add_quality_features(df).select("id", *fe.QUALITY_FEATURES)


LOG_GIVEN = ("LotArea", "GrLivArea", "PoolArea", "TotalBsmtSF", "GarageArea")


@register("log_transform_given", "P15 A10", with_listing("""
SELECT id, round(ln(1 + LotArea), 6) AS LotArea_log, round(ln(1 + GrLivArea), 6) AS GrLivArea_log,
       round(ln(1 + PoolArea), 6) AS PoolArea_log, round(ln(1 + TotalBsmtSF), 6) AS TotalBsmtSF_log,
       round(ln(1 + GarageArea), 6) AS GarageArea_log
FROM listing"""))
def log_transform_given(spark, sf):
    df = listing(spark, sf)
    m = fe.fit_log_transform(df, list(LOG_GIVEN))
    out = m.transform(df)
    return out.select("id", *[_r(f"{c}_log").alias(f"{c}_log") for c in m.columns])


_NUM = ("LotArea", "YearBuilt", "YearRemodAdd", "TotalBsmtSF", "GrLivArea", "FullBath", "HalfBath",
        "BedroomAbvGr", "TotRmsAbvGrd", "GarageArea", "PoolArea", "OverallQual", "OverallCond")


def _unpivot_sql(cols, src="listing"):
    return f"(UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM {src}) " \
           f"ON {', '.join(cols)} INTO NAME feature VALUE v)"


@register("log_transform_auto", "P16 A9 A10", with_listing(f"""
SELECT feature AS "column", round(skewness(v), 6) AS skewness, min(v) AS min_value,
       (abs(skewness(v)) > 0.75 AND min(v) >= 0) AS transformed
FROM {_unpivot_sql(_NUM)}
GROUP BY feature"""))
def log_transform_auto(spark, sf):
    from ..functions.moments import sample_skewness
    df = listing(spark, sf).select(*_NUM)
    m = fe.fit_log_transform(df, None)
    one = df.agg(*[F.struct(F.lit(c).alias("column"), _r(sample_skewness(F.col(c).cast("double"))).alias("skewness"),
                            F.min(F.col(c).cast("double")).alias("min_value")).alias(f"s{i}")
                   for i, c in enumerate(_NUM)])
    rows = one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(_NUM))])).alias("s")).select("s.*")
    return rows.withColumn("transformed", F.col("column").isin(list(m.columns)))


def _split_train_sql():
    return f"{bucket_sql('id', 10000, 42)} >= 2000"


@register("target_encode", "T7 J1 A7 A8", with_listing(f"""
, means AS (SELECT Neighborhood AS k, avg(CAST(SalePrice AS DOUBLE)) AS m FROM listing
            WHERE {_split_train_sql()} AND Neighborhood IS NOT NULL GROUP BY Neighborhood),
  g AS (SELECT avg(m) AS d FROM means)
SELECT id, Neighborhood, round(coalesce(means.m, g.d), 6) AS NeighborhoodAvgPrice
FROM listing LEFT JOIN means ON listing.Neighborhood = means.k CROSS JOIN g""".replace("\n, means", ",\nmeans", 1)))
def target_encode(spark, sf):
    df = listing(spark, sf)
    train = assign_split(df).filter(F.col("split") == "train")
    enc = fe.fit_target_encoder(train, "Neighborhood", "SalePrice")
    out = enc.transform(df)
    return out.select("id", "Neighborhood", _r("NeighborhoodAvgPrice").alias("NeighborhoodAvgPrice"))


@register("group_mean", "A7", with_listing("""
SELECT Neighborhood, round(avg(CAST(SalePrice AS DOUBLE)), 6) AS mean_target, count(*) AS n
FROM listing GROUP BY Neighborhood"""))
def group_mean(spark, sf):
    from ..operators.profile import group_mean as gm
    out = gm(listing(spark, sf), "Neighborhood")
    return out.select("Neighborhood", _r("mean_target").alias("mean_target"), "n")


@register("derive_subset_single", "P21", with_listing("""
SELECT id, 2024 - YearBuilt AS HouseAge, YearRemodAdd - YearBuilt AS RemodelAge,
       CAST(CASE WHEN YearRemodAdd - YearBuilt > 0 THEN 1 ELSE 0 END AS INTEGER) AS IsRemodeled,
       coalesce(CAST(GrLivArea AS DOUBLE), 0.0::DOUBLE) + coalesce(CAST(TotalBsmtSF AS DOUBLE), 0.0::DOUBLE) AS TotalSF,
       CAST(FullBath AS DOUBLE) + HalfBath * 0.5::DOUBLE AS TotalBathrooms,
       OverallQual * OverallCond AS QualityScore,
       CAST(CASE WHEN OverallQual >= 8 THEN 1 ELSE 0 END AS INTEGER) AS IsHighQuality
FROM listing"""))
def derive_subset_single(spark, sf):
    out = fe.derive(listing(spark, sf), only=fe.SINGLE_RECORD_FEATURES)
    return out.select("id", *fe.SINGLE_RECORD_FEATURES)


@register("derive_subset_batch", "P22", with_listing("""
SELECT id, 2024 - YearBuilt AS HouseAge,
       coalesce(CAST(GrLivArea AS DOUBLE), 0.0::DOUBLE) + coalesce(CAST(TotalBsmtSF AS DOUBLE), 0.0::DOUBLE) AS TotalSF
FROM listing"""))
def derive_subset_batch(spark, sf):
    out = fe.derive(listing(spark, sf), only=fe.BATCH_FEATURES)
    return out.select("id", *fe.BATCH_FEATURES)


ALIGN_NAMES = ("GrLivArea", "OverallQual", "HouseAge", "NeighborhoodAvgPrice", "TotalSF", "PoolArea_log")


@register("align_features", "P20", with_listing("""
SELECT id, CAST(GrLivArea AS BIGINT) AS GrLivArea, OverallQual, 2024 - YearBuilt AS HouseAge,
       0.0::DOUBLE AS NeighborhoodAvgPrice,
       coalesce(CAST(GrLivArea AS DOUBLE), 0.0::DOUBLE) + coalesce(CAST(TotalBsmtSF AS DOUBLE), 0.0::DOUBLE) AS TotalSF,
       0.0::DOUBLE AS PoolArea_log
FROM listing"""))
def align_features(spark, sf):
    df = fe.derive(listing(spark, sf), only=("HouseAge", "TotalSF"))
    return fe.align_features(df, ALIGN_NAMES, keep=("id",))


HEDONIC_SQL = """
CAST((CAST(floor(least(greatest(
  (40000.0::DOUBLE + exp(0.28::DOUBLE * OverallQual) * 8500 + OverallCond * 2000 + GrLivArea * 62
   + TotalBsmtSF * 18 + GarageArea * 28 + LotArea * 1.2::DOUBLE + (YearBuilt - 1872) * 280
   + (YearRemodAdd - YearBuilt) * 150 + FullBath * 6000 + HalfBath * 3000
   + CASE WHEN PoolArea > 0 THEN 5000 + PoolArea * 40 ELSE 0 END)
  * CASE Neighborhood WHEN 'NoRidge' THEN 1.35::DOUBLE WHEN 'NridgHt' THEN 1.35::DOUBLE WHEN 'StoneBr' THEN 1.35::DOUBLE
      WHEN 'Timber' THEN 1.2::DOUBLE WHEN 'Somerst' THEN 1.2::DOUBLE WHEN 'CollgCr' THEN 1.1::DOUBLE
      WHEN 'Crawfor' THEN 1.1::DOUBLE WHEN 'ClearCr' THEN 1.1::DOUBLE WHEN 'Mitchel' THEN 0.95::DOUBLE
      WHEN 'Sawyer' THEN 0.95::DOUBLE WHEN 'OldTown' THEN 0.88::DOUBLE WHEN 'BrkSide' THEN 0.88::DOUBLE
      WHEN 'IDOTRR' THEN 0.88::DOUBLE WHEN 'Edwards' THEN 0.88::DOUBLE WHEN 'MeadowV' THEN 0.82::DOUBLE
      WHEN 'SWISU' THEN 0.82::DOUBLE ELSE 1.0::DOUBLE END
  * CASE ExterQual WHEN 'Ex' THEN 1.15::DOUBLE WHEN 'Gd' THEN 1.06::DOUBLE WHEN 'TA' THEN 1.0::DOUBLE
      WHEN 'Fa' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
  * 1.0::DOUBLE
  * CASE BldgType WHEN '1Fam' THEN 1.0::DOUBLE WHEN 'TwnhsE' THEN 0.95::DOUBLE WHEN 'Duplex' THEN 0.9::DOUBLE
      WHEN 'Twnhs' THEN 0.9::DOUBLE WHEN '2fmCon' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END,
  34900.0::DOUBLE), 755000.0::DOUBLE)) AS BIGINT) + 50) // 100 * 100 AS BIGINT)"""


@register("hedonic_price", "P26", with_listing(f"SELECT id, {HEDONIC_SQL} AS HedonicPrice FROM listing"))
def hedonic_price(spark, sf):
    return pr.hedonic_price(listing(spark, sf)).select("id", "HedonicPrice")


@register("lookup_multiplier", "J2", with_listing("""
SELECT id,
  CASE Neighborhood WHEN 'NoRidge' THEN 1.35::DOUBLE WHEN 'NridgHt' THEN 1.35::DOUBLE WHEN 'StoneBr' THEN 1.35::DOUBLE
      WHEN 'Timber' THEN 1.2::DOUBLE WHEN 'Somerst' THEN 1.2::DOUBLE WHEN 'CollgCr' THEN 1.1::DOUBLE
      WHEN 'Crawfor' THEN 1.1::DOUBLE WHEN 'ClearCr' THEN 1.1::DOUBLE WHEN 'Mitchel' THEN 0.95::DOUBLE
      WHEN 'Sawyer' THEN 0.95::DOUBLE WHEN 'OldTown' THEN 0.88::DOUBLE WHEN 'BrkSide' THEN 0.88::DOUBLE
      WHEN 'IDOTRR' THEN 0.88::DOUBLE WHEN 'Edwards' THEN 0.88::DOUBLE WHEN 'MeadowV' THEN 0.82::DOUBLE
      WHEN 'SWISU' THEN 0.82::DOUBLE ELSE 1.0::DOUBLE END AS neighborhood_mult,
  CASE ExterQual WHEN 'Ex' THEN 1.15::DOUBLE WHEN 'Gd' THEN 1.06::DOUBLE WHEN 'TA' THEN 1.0::DOUBLE
      WHEN 'Fa' THEN 0.9::DOUBLE END AS exter_mult,
  CASE BldgType WHEN '1Fam' THEN 1.0::DOUBLE WHEN 'TwnhsE' THEN 0.95::DOUBLE WHEN 'Duplex' THEN 0.9::DOUBLE
      WHEN 'Twnhs' THEN 0.9::DOUBLE WHEN '2fmCon' THEN 0.85::DOUBLE END AS bldg_mult
FROM listing"""))
def lookup_multiplier(spark, sf):
    """Neighbourhood lookup with default 1.0; the strict lookups give NULL
    for an unknown key (``check_multiplier_keys`` lists those keys)."""
    from ..functions.pricing import BLDG_MULT, EXTER_MULT, NEIGHBORHOOD_MULT, multiplier
    df = listing(spark, sf)
    return df.select("id", multiplier("Neighborhood", NEIGHBORHOOD_MULT, 1.0).alias("neighborhood_mult"),
                     multiplier("ExterQual", EXTER_MULT, None).alias("exter_mult"),
                     multiplier("BldgType", BLDG_MULT, None).alias("bldg_mult"))


@register("strict_lookup_keys", "J2", with_listing("""
SELECT 'ExterQual' AS "column", ExterQual AS value FROM listing WHERE ExterQual NOT IN ('Ex', 'Gd', 'TA', 'Fa') GROUP BY ExterQual
UNION ALL
SELECT 'BldgType', BldgType FROM listing WHERE BldgType NOT IN ('1Fam', 'TwnhsE', 'Duplex', 'Twnhs', '2fmCon') GROUP BY BldgType"""))
def strict_lookup_keys(spark, sf):
    """Strict lookups: the keys for which pricing would stop."""
    return pr.check_multiplier_keys(listing(spark, sf))


@register("label_reattach", "J4 P1", with_listing("""
SELECT x.id, x.GrLivArea, x.OverallQual, y.SalePrice
FROM (SELECT id, GrLivArea, OverallQual FROM listing) x JOIN (SELECT id, SalePrice FROM listing) y ON x.id = y.id"""))
def label_reattach(spark, sf):
    from ..roles import split_features_target
    X, y = split_features_target(listing(spark, sf))
    return X.select("id", "GrLivArea", "OverallQual").join(y, "id", "inner")


WHAT_IF_VALUES = (3, 5, 7, 9)


@register("what_if", "M18", with_listing("""
, s AS (SELECT * EXCLUDE (OverallQual), CAST(v AS BIGINT) AS OverallQual, CAST(v AS DOUBLE) AS scenario_value
        FROM listing CROSS JOIN (VALUES (3), (5), (7), (9)) t(v))
SELECT id, 'OverallQual' AS feature, scenario_value, """.replace("\n, s AS", ",\ns AS", 1) + HEDONIC_SQL + " AS price FROM s"))
def what_if(spark, sf):
    return pr.what_if(listing(spark, sf), "OverallQual", list(WHAT_IF_VALUES))
