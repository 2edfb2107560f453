"""Derived columns (P2-P14, P20-P22), log transforms (P15-P16), target
encoding (T7 / J1 / A7 / A8) and the full feature step (P17).

Every derivation step is a single ``select`` whose list is built once from
the columns present (P14 presence guards), so Catalyst collapses the whole
chain into one projection inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import sample_skewness
from ..functions.numeric import flag, null_sum, safe_div
from ..roles import HOUSING_TARGET, numeric_columns
from ..sources.tables import broadcast_if_small, cut_lineage, persisted

# Fixed value: the reference's "current year".
REF_YEAR = 2024
# Fixed value: |skew| above which a column is log transformed.
SKEW_THRESHOLD = 0.75

AGE_FEATURES = ("HouseAge", "RemodelAge", "IsRemodeled", "YearsAfterRemodel")
AREA_FEATURES = ("TotalSF", "TotalBathrooms", "HasPool", "HasGarage", "LotAreaPerRoom", "AreaPerBath")
QUALITY_FEATURES = ("QualityScore", "QualCondRatio", "IsHighQuality")


def _age_exprs(cols: set, ref_year: int) -> dict[str, Column]:
    c = F.col
    out: dict[str, Column] = {}
    if "YearBuilt" in cols:
        out["HouseAge"] = F.lit(ref_year) - c("YearBuilt")
    if "YearRemodAdd" in cols and "YearBuilt" in cols:
        remodel_age = c("YearRemodAdd") - c("YearBuilt")
        out["RemodelAge"] = remodel_age
        out["IsRemodeled"] = flag(remodel_age > 0)
        out["YearsAfterRemodel"] = F.lit(ref_year) - c("YearRemodAdd")
    return out


def _area_exprs(cols: set) -> dict[str, Column]:
    c = F.col
    out: dict[str, Column] = {}
    sf = [x for x in ("GrLivArea", "TotalBsmtSF") if x in cols]
    if sf:
        out["TotalSF"] = null_sum(sf)
    baths = []
    if "FullBath" in cols:
        baths.append(c("FullBath").cast("double"))
    if "HalfBath" in cols:
        baths.append(c("HalfBath") * 0.5)
    total_baths = None
    if baths:
        total_baths = baths[0] if len(baths) == 1 else baths[0] + baths[1]
        out["TotalBathrooms"] = total_baths
    if "PoolArea" in cols:
        out["HasPool"] = flag(c("PoolArea") > 0)
    if "GarageArea" in cols:
        out["HasGarage"] = flag(c("GarageArea") > 0)
    if "LotArea" in cols and "TotRmsAbvGrd" in cols:
        out["LotAreaPerRoom"] = safe_div(c("LotArea"), c("TotRmsAbvGrd") + 1)
    if "GrLivArea" in cols and total_baths is not None:
        out["AreaPerBath"] = safe_div(c("GrLivArea"), total_baths + 1)
    return out


def _quality_exprs(cols: set) -> dict[str, Column]:
    c = F.col
    out: dict[str, Column] = {}
    if "OverallQual" in cols and "OverallCond" in cols:
        out["QualityScore"] = c("OverallQual") * c("OverallCond")
        out["QualCondRatio"] = safe_div(c("OverallQual"), c("OverallCond") + 1)
        out["IsHighQuality"] = flag(c("OverallQual") >= 8)
    return out


def derived_exprs(df: DataFrame, groups=("age", "area", "quality"), only=None,
                  ref_year: int = REF_YEAR) -> dict[str, Column]:
    cols = set(df.columns)
    exprs: dict[str, Column] = {}
    if "age" in groups:
        exprs.update(_age_exprs(cols, ref_year))
    if "area" in groups:
        exprs.update(_area_exprs(cols))
    if "quality" in groups:
        exprs.update(_quality_exprs(cols))
    if only is not None:
        exprs = {k: v for k, v in exprs.items() if k in set(only)}
    return exprs


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One projection: existing columns (replaced in place when re-derived)
    followed by the new ones."""
    keep = [F.col(c) if c not in exprs else exprs[c].alias(c) for c in df.columns]
    new = [e.alias(k) for k, e in exprs.items() if k not in df.columns]
    return df.select(*keep, *new)


def add_age_features(df: DataFrame, ref_year: int = REF_YEAR) -> DataFrame:
    return with_columns(df, derived_exprs(df, ("age",), ref_year=ref_year))


def add_area_features(df: DataFrame) -> DataFrame:
    return with_columns(df, derived_exprs(df, ("area",)))


def add_quality_features(df: DataFrame) -> DataFrame:
    return with_columns(df, derived_exprs(df, ("quality",)))


def derive(df: DataFrame, only=None, ref_year: int = REF_YEAR) -> DataFrame:
    """All derivations in one select; ``only`` restricts to a subset."""
    return with_columns(df, derived_exprs(df, only=only, ref_year=ref_year))


# The scorer's reduced derivation lists (single record, batch).
SINGLE_RECORD_FEATURES = ("HouseAge", "RemodelAge", "IsRemodeled", "TotalSF", "TotalBathrooms",
                          "QualityScore", "IsHighQuality")
BATCH_FEATURES = ("HouseAge", "TotalSF")


def align_features(df: DataFrame, names, keep=()) -> DataFrame:
    """P20: expected columns in a fixed order, missing ones filled with 0."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep if k in present]
    cols += [F.col(n) if n in present else F.lit(0.0).alias(n) for n in names]
    return df.select(*cols)


# ---------------------------------------------------------------- log step

@dataclass
class LogTransformModel:
    columns: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {f"{c}_log": F.log1p(F.col(c).cast("double")) for c in self.columns if c in df.columns}
        return with_columns(df, exprs)


def fit_log_transform(df: DataFrame, columns=None, target: str = HOUSING_TARGET,
                      threshold: float = SKEW_THRESHOLD, exclude=("id",)) -> LogTransformModel:
    """Given columns, or auto-detected |sample skew| > threshold;
    a column qualifies only if its minimum is >= 0 (a NULL minimum fails).
    One aggregation pass computes every skew and minimum."""
    auto = columns is None
    cands = ([c for c in numeric_columns(df, exclude=tuple(exclude)) if c != target] if auto
             else [c for c in columns if c in df.columns])
    if not cands:
        return LogTransformModel([])
    aggs = []
    for i, c in enumerate(cands):
        x = F.col(c).cast("double")
        aggs.append(F.min(x).alias(f"m{i}"))
        if auto:
            aggs.append(sample_skewness(x).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    chosen = []
    for i, c in enumerate(cands):
        if auto:
            s = row[f"s{i}"]
            if s is None or s != s or abs(s) <= threshold:
                continue
        m = row[f"m{i}"]
        if m is not None and m == m and m >= 0:
            chosen.append(c)
    return LogTransformModel(chosen)


def apply_log_transform(df: DataFrame, columns=None, target: str = HOUSING_TARGET) -> DataFrame:
    return fit_log_transform(df, columns, target).transform(df)


# ---------------------------------------------------------- target encoding

@dataclass
class TargetEncoderModel:
    key: str
    output: str
    means: DataFrame | None      # (key, mean) small table, one row per category
    default: float | None        # unweighted mean of the category means

    def transform(self, df: DataFrame) -> DataFrame:
        if self.key not in df.columns or self.means is None or self.default is None:
            return df
        m = self.means.withColumnRenamed(self.key, "_te_key")
        joined = df.join(broadcast_if_small(m), df[self.key] == F.col("_te_key"), "left")
        value = F.coalesce(F.col("_te_mean"), F.lit(float(self.default)))
        return joined.select(*[df[c] for c in df.columns], value.alias(self.output))


def fit_target_encoder(df: DataFrame, key: str = "Neighborhood", target: str = HOUSING_TARGET,
                       output: str = "NeighborhoodAvgPrice") -> TargetEncoderModel:
    """A7 group means (partial aggregation before the shuffle, so a hot key
    is pre-combined per task) and A8 the mean of the means."""
    if key not in df.columns or target not in df.columns:
        return TargetEncoderModel(key, output, None, None)
    means = cut_lineage(df.filter(F.col(key).isNotNull()).groupBy(key)
                          .agg(F.avg(F.col(target).cast("double")).alias("_te_mean")))
    default = means.agg(F.avg("_te_mean").alias("d")).first()["d"]
    return TargetEncoderModel(key, output, means, default)


# ---------------------------------------------------------- full feature step

@dataclass
class FeatureEngineerModel:
    ref_year: int
    encoder: TargetEncoderModel
    log: LogTransformModel
    added: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = derive(df, ref_year=self.ref_year)
        out = self.encoder.transform(out)
        return self.log.transform(out)


def fit_feature_engineer(df: DataFrame, target: str = HOUSING_TARGET, key: str = "Neighborhood",
                         ref_year: int = REF_YEAR, log_columns=None, exclude=("id",), fit_scope: str = "all",
                         split_col: str = "split") -> FeatureEngineerModel:
    """Age -> area -> quality -> target encoding -> auto log (in order).
    The skew scan sees the derived and encoded columns, as in the reference.
    ``fit_scope="train"`` learns the means and the skewed columns from the rows
    whose ``split_col`` is 'train' alone, so that no test price leaks into a
    feature; "all" learns from every row, as the reference does."""
    if fit_scope not in ("all", "train"):
        raise ValueError(f"fit_scope is 'all' or 'train', not {fit_scope!r}")
    derived = derive(df, ref_year=ref_year)
    # the encoder fit and the skew scan both read the derived numeric columns
    keep = [c for c in derived.columns if c == key or c == target or c in numeric_columns(derived)]
    seen = derived.where(F.col(split_col) == "train") if fit_scope == "train" else derived
    with persisted(seen, keep) as src:
        enc = fit_target_encoder(src, key, target)
        encoded = enc.transform(src)
        log = fit_log_transform(encoded, log_columns, target, exclude=exclude)
    model = FeatureEngineerModel(ref_year, enc, log)
    model.added = [c for c in log.transform(enc.transform(derived)).columns if c not in df.columns]
    return model
