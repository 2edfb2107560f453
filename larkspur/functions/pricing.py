"""The additive hedonic price formula as one Column expression tree.

Used two ways: as a deterministic scoring operator (``hedonic_price``) and to
build the housing-shaped ``listing`` table from the star-schema tables.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category multipliers of the price formula.
NEIGHBORHOOD_MULT = {
    "NoRidge": 1.35, "NridgHt": 1.35, "StoneBr": 1.35,
    "Timber": 1.20, "Somerst": 1.20, "CollgCr": 1.10,
    "Crawfor": 1.10, "ClearCr": 1.10,
    "NAmes": 1.00, "Gilbert": 1.00, "NWAmes": 1.00,
    "SawyerW": 1.00, "Mitchel": 0.95, "Sawyer": 0.95,
    "OldTown": 0.88, "BrkSide": 0.88, "IDOTRR": 0.88,
    "Edwards": 0.88, "MeadowV": 0.82, "SWISU": 0.82,
}
EXTER_MULT = {"Ex": 1.15, "Gd": 1.06, "TA": 1.00, "Fa": 0.90}
KITCHEN_MULT = {"Ex": 1.10, "Gd": 1.05, "TA": 1.00, "Fa": 0.91}
BLDG_MULT = {"1Fam": 1.0, "TwnhsE": 0.95, "Duplex": 0.90, "Twnhs": 0.90, "2fmCon": 0.85}

# Formula coefficients, clip range and rounding step.
PRICE_INTERCEPT = 40000
QUAL_EXP_RATE = 0.28
QUAL_EXP_SCALE = 8500
PRICE_MIN, PRICE_MAX, PRICE_STEP = 34900, 755000, 100
BASE_YEAR = 1872

# column -> (multiplier table, default when the key is unknown; None = strict)
MULTIPLIERS = {
    "Neighborhood": (NEIGHBORHOOD_MULT, 1.0),
    "ExterQual": (EXTER_MULT, None),
    "KitchenQual": (KITCHEN_MULT, None),
    "BldgType": (BLDG_MULT, None),
}


def literal_map(table: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in table.items()))


def multiplier(column: str, table: dict, default: float | None = 1.0) -> Column:
    """Category -> multiplier lookup; unknown keys give ``default``.

    With ``default=None`` (strict) an unknown key yields NULL, which the
    strict check in ``operators.pricing.check_multiplier_keys`` turns into an
    error before scoring.
    """
    looked = F.try_element_at(literal_map(table), F.col(column))
    if default is None:
        return looked
    return F.coalesce(looked, F.lit(float(default)))


def base_price(qual="OverallQual", cond="OverallCond", area="GrLivArea", bsmt="TotalBsmtSF",
               garage="GarageArea", lot="LotArea", built="YearBuilt", remod="YearRemodAdd",
               full="FullBath", half="HalfBath", pool="PoolArea") -> Column:
    """P26 additive part, summed left to right (the order fixes float rounding)."""
    c = F.col
    pool_term = F.when(c(pool) > 0, F.lit(5000) + c(pool) * 40).otherwise(F.lit(0))
    terms = [
        F.exp(F.lit(QUAL_EXP_RATE) * c(qual)) * QUAL_EXP_SCALE,
        c(cond) * 2000,
        c(area) * 62,
        c(bsmt) * 18,
        c(garage) * 28,
        c(lot) * 1.2,
        (c(built) - BASE_YEAR) * 280,
        (c(remod) - c(built)) * 150,
        c(full) * 6000,
        c(half) * 3000,
        pool_term,
    ]
    out = F.lit(float(PRICE_INTERCEPT))
    for t in terms:
        out = out + t
    return out


def with_clip_round_price(df, raw: Column, output: str):
    """Clip to the price range, truncate to an integer, round to 100.

    The floored price is staged as its own column: it is referenced twice
    by the rounding, and a collapsed projection would otherwise repeat the
    whole formula tree per reference (large enough to fall out of
    whole-stage code generation)."""
    # greatest() skips NULL: a row with a missing input has no price
    clipped = F.least(F.greatest(F.col("_price_raw"), F.lit(float(PRICE_MIN))), F.lit(float(PRICE_MAX)))
    floored = F.when(F.col("_price_raw").isNotNull(), F.floor(clipped))
    shifted = F.col("_price_floor") + F.lit(PRICE_STEP // 2)
    return (df.withColumn("_price_raw", raw).withColumn("_price_floor", floored)
              .withColumn(output, (shifted - F.pmod(shifted, F.lit(PRICE_STEP))).cast("long"))
              .drop("_price_raw", "_price_floor"))
