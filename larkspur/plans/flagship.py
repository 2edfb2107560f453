"""Flagship query: scan -> join (listing) -> derived features -> target
encoding (group means, broadcast lookup) -> grouped report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..sources.listing import listing


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fe.derive(listing(spark, sf_dir))
    enc = fe.fit_target_encoder(df, "Neighborhood", "SalePrice")
    out = enc.transform(df)
    return (out.groupBy("Neighborhood")
               .agg(F.count(F.lit(1)).alias("n"),
                    F.round(F.avg("NeighborhoodAvgPrice"), 6).alias("encoded_price"),
                    F.round(F.avg("TotalSF"), 6).alias("mean_total_sf"),
                    F.round(F.avg("HouseAge"), 6).alias("mean_house_age"),
                    F.round(F.avg("QualityScore"), 6).alias("mean_quality_score"))
               .orderBy("Neighborhood"))
