"""Deterministic price scoring (P26), multiplier lookups (J2) and what-if
scenarios (M18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import MULTIPLIERS, base_price, multiplier, with_clip_round_price


def multipliers(df: DataFrame, strict: bool = False) -> dict:
    """Column expressions of the category multipliers present in ``df``;
    absent columns contribute 1.0."""
    out = {}
    for col, (table, default) in MULTIPLIERS.items():
        if col in df.columns:
            out[col] = multiplier(col, table, None if (strict and default is None) else (default or 1.0))
        else:
            out[col] = F.lit(1.0)
    return out


def check_multiplier_keys(df: DataFrame) -> DataFrame:
    """Strict lookup check: (column, value) pairs with no multiplier, found
    by a left-anti join against the (small, fixed) lookup tables."""
    spark = df.sparkSession
    parts = []
    for col, (table, default) in MULTIPLIERS.items():
        if default is not None or col not in df.columns:
            continue
        keys = spark.createDataFrame([(k,) for k in table], "value string")
        vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
        parts.append(vals.join(F.broadcast(keys), "value", "left_anti").select(F.lit(col).alias("column"), "value"))
    if not parts:
        return spark.createDataFrame([], "column string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hedonic_price(df: DataFrame, output: str = "HedonicPrice", strict: bool = False) -> DataFrame:
    """Additive base x category multipliers, clipped and rounded to 100."""
    if strict:
        bad = check_multiplier_keys(df).limit(1).collect()
        if bad:
            raise KeyError(f"no multiplier for {bad[0]['column']}={bad[0]['value']!r}")
    m = multipliers(df, strict)
    raw = base_price() * m["Neighborhood"] * m["ExterQual"] * m["KitchenQual"] * m["BldgType"]
    return with_clip_round_price(df, raw, output)


def what_if(base: DataFrame, feature: str, values, price_fn=hedonic_price, key: str = "id",
            output: str = "HedonicPrice") -> DataFrame:
    """Every base row x every scenario value of one feature, priced in
    one pass. The value list is a literal array exploded per row (its size is
    the caller's list), so no join and no shuffle."""
    vals = F.array(*[F.lit(v) for v in values])
    dtype = base.schema[feature].dataType
    scen = (base.withColumn("scenario_value", F.explode(vals))
                .withColumn(feature, F.col("scenario_value").cast(dtype)))
    priced = price_fn(scen)
    return priced.select(key, F.lit(feature).alias("feature"), F.col("scenario_value").cast("double"),
                         F.col(output).alias("price"))
