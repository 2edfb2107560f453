"""Cleaning: imputation (T1-T3), outlier filters and report (F1-F3),
input range validation (F6), NA-token normalisation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import HOUSING, ColumnRoles
from ..sources.tables import persisted
from .quantiles import descent_quantiles, quantiles

# Constant fills applied by the reference after imputation.
CONSTANT_FILLS = {"PoolArea": 0, "GarageArea": 0, "TotalBsmtSF": 0, "GarageType": "None"}


def column_modes(df: DataFrame, cols) -> dict[str, str | None]:
    """Most frequent value per column, ties -> smallest value.

    One unpivot + one grouped count over (column, value): map-side partial
    aggregation collapses hot values before the shuffle, and the result has
    one row per distinct (column, value) pair. The winner per column is
    picked with ``min_by`` over (-count, value) -- no window, no collect of
    the value list.
    """
    cols = list(cols)
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p"))
    counts = (pairs.select("p.k", "p.v").where(F.col("v").isNotNull())
                   .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("k").agg(F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("mode"))
    found = {r["k"]: r["mode"] for r in best.collect()}   # one row per column
    return {c: found.get(c) for c in cols}


@dataclass
class ImputerModel:
    numeric_fill: dict = field(default_factory=dict)
    categorical_fill: dict = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    constants_first: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        consts = {k: v for k, v in self.constants.items() if k in df.columns}
        out = []
        for c in df.columns:
            e: Column = F.col(c)
            dtype = df.schema[c].dataType.simpleString()
            fills = []
            if self.constants_first and c in consts:
                fills.append(consts[c])
            if c in self.numeric_fill and self.numeric_fill[c] is not None:
                fills.append(self.numeric_fill[c])
            if c in self.categorical_fill and self.categorical_fill[c] is not None:
                fills.append(self.categorical_fill[c])
            if not self.constants_first and c in consts:
                fills.append(consts[c])
            if fills:
                target_type = "double" if c in self.numeric_fill else dtype
                e = F.coalesce(e.cast(target_type), *[F.lit(v).cast(target_type) for v in fills])
            out.append(e.alias(c))
        return df.select(*out)


def fit_imputer(df: DataFrame, roles: ColumnRoles = HOUSING, strategy: str = "median",
                exact: bool = True, constants: dict | None = None,
                constants_first: bool = False) -> ImputerModel:
    """T1/T2/T3. Numeric strategy median (exact, interpolated), mean or
    most_frequent; categorical most frequent. Always fitted (the reference
    leaves imputers unfitted when the training frame has no NULL)."""
    r = roles.present(df)
    num, cat = list(r.numeric), list(r.categorical)
    with persisted(df, num + cat) as src:
        return _fit_imputer(src, num, cat, strategy, exact, constants, constants_first)


def _fit_imputer(df, num, cat, strategy, exact, constants, constants_first) -> ImputerModel:
    if strategy == "median":
        q = quantiles(df, num, [0.5], exact=exact)
        num_fill = {c: q[c][0] for c in num}
    elif strategy == "mean":
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in num]).first() if num else {}
        num_fill = {c: row[c] for c in num}
    elif strategy == "most_frequent":
        modes = column_modes(df, num)
        num_fill = {c: (float(v) if v is not None else None) for c, v in modes.items()}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    cat_fill = column_modes(df, cat)
    return ImputerModel(num_fill, cat_fill, dict(CONSTANT_FILLS if constants is None else constants),
                        constants_first)


def fill_constants(df: DataFrame, constants: dict | None = None) -> DataFrame:
    """T3 alone: ``na.fill`` of the constant columns that exist."""
    consts = {k: v for k, v in (CONSTANT_FILLS if constants is None else constants).items()
              if k in df.columns}
    return df.na.fill(consts) if consts else df


def normalize_na(df: DataFrame, tokens=("NA", "None", "nan", "NaN", "")) -> DataFrame:
    """Treat NA tokens in text columns and NaN in doubles as NULL."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f.name)
        if t == "string":
            c = F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)
        elif t in ("double", "float"):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


# ------------------------------------------------------------------ outliers

def iqr_bounds(df: DataFrame, col: str, threshold: float = 3.0, exact: bool = True):
    q1, q3 = descent_quantiles(df, col, [0.25, 0.75]) if exact else quantiles(df, [col], [0.25, 0.75], exact=False)[col]
    if q1 is None:
        return None, None
    iqr = q3 - q1
    return q1 - threshold * iqr, q3 + threshold * iqr


def remove_outliers_iqr(df: DataFrame, columns=None, threshold: float = 3.0,
                        exact: bool = True) -> DataFrame:
    """F1, sequential: the quartiles of column k come from the rows that
    survived columns 1..k-1. Only the screened columns are persisted (one
    narrow projection, recomputable from lineage on executor loss); each
    step adds literal bounds to one conjunction, and the input is filtered
    once at the end -- literal bounds that Catalyst can push to the scan."""
    cols = [c for c in (columns or HOUSING.outlier) if c in df.columns]
    if not cols:
        return df
    narrow = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    cond = F.lit(True)
    try:
        for c in cols:
            lo, hi = iqr_bounds(narrow.filter(cond), c, threshold, exact)
            if lo is None:
                return df.limit(0)
            cond = cond & (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))
    finally:
        narrow.unpersist()
    return df.filter(cond)


def remove_outliers_zscore(df: DataFrame, columns=None, threshold: float = 3.0) -> DataFrame:
    """population std; keep rows where every |z| < threshold (strict).
    NULL policy: statistics skip NULLs; a row with a NULL in a screened
    column is dropped (its z is undefined)."""
    cols = [c for c in (columns or HOUSING.outlier) if c in df.columns]
    if not cols:
        return df
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    cond = F.lit(True)
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None or not s:
            return df.limit(0)   # undefined z for every row (scipy gives NaN)
        cond = cond & (F.abs((F.col(c) - F.lit(m)) / F.lit(s)) < F.lit(threshold))
    return df.filter(cond)


def remove_outliers(df: DataFrame, method: str = "iqr", threshold: float = 3.0, columns=None) -> DataFrame:
    if method == "iqr":
        return remove_outliers_iqr(df, columns, threshold)
    if method == "zscore":
        return remove_outliers_zscore(df, columns, threshold)
    return df


def outlier_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows before, after, removed and percent removed (one row)."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).select(
        "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.round(F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0,
                             F.col("rows_before")), 6).alias("pct_removed"))


# --------------------------------------------------------- range validation

# Form input ranges and defaults (min, max, default).
INPUT_RANGES = {
    "LotArea": (500, 500000, 8500),
    "YearBuilt": (1800, 2025, 2000),
    "YearRemodAdd": (1800, 2025, 2000),
    "TotalBsmtSF": (0, 10000, 800),
    "GrLivArea": (200, 10000, 1500),
    "FullBath": (0, 5, 2),
    "HalfBath": (0, 3, 0),
    "BedroomAbvGr": (0, 10, 3),
    "TotRmsAbvGrd": (1, 15, 6),
    "GarageArea": (0, 5000, 400),
    "PoolArea": (0, 2000, 0),
    "OverallQual": (1, 10, 5),
    "OverallCond": (1, 10, 5),
}


def validate_ranges(df: DataFrame, ranges: dict | None = None, keep=("id",)) -> DataFrame:
    """NULL -> default; an array of the names of columns outside their
    range; the value itself is kept (clamping is the caller's choice)."""
    ranges = {k: v for k, v in (ranges or INPUT_RANGES).items() if k in df.columns}
    cols = [F.col(k) for k in keep if k in df.columns]
    viol = []
    for name, (lo, hi, default) in ranges.items():
        v = F.coalesce(F.col(name), F.lit(default).cast(df.schema[name].dataType))
        cols.append(v.alias(name))
        viol.append(F.when((v < lo) | (v > hi), F.lit(name)))
    cols.append(F.filter(F.array(*viol), lambda x: x.isNotNull()).alias("violations"))
    return df.select(*cols)
