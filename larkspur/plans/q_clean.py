"""Queries: profiling/EDA (A1-A19, A29-A30, F4, F7), cleaning (F1-F3, F6,
T1-T3), encoding/scaling (T4-T8), split and folds (T9, R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket_sql, mix_key_sql
from ..operators import clean as cl
from ..operators import encode as en
from ..operators import profile as pf
from ..operators.split import assign_folds, assign_split, with_curve_share
from ..sources.listing import dirty_listing, listing
from ..sources.tables import cut_lineage
from .oracle_base import with_dirty_listing, with_listing
from .q_features import _NUM, _r, _unpivot_sql
from .registry import register

LISTING_COLS = ("id",) + _NUM + ("MSZoning", "Street", "LotShape", "Utilities", "Neighborhood", "BldgType",
                                 "HouseStyle", "ExterQual", "SalePrice")
NUM_T = _NUM + ("SalePrice",)


def _round_cols(df, cols, k=6):
    return df.select(*[_r(c, k).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ profile

@register("profile_shape", "A1 P18", with_listing(f"""
SELECT count(*) AS total_rows, CAST(23 AS BIGINT) AS total_columns, CAST(15 AS BIGINT) AS n_numeric,
       CAST(8 AS BIGINT) AS n_categorical,
       '{",".join(("id",) + _NUM + ("SalePrice",))}' AS numeric_columns,
       'MSZoning,Street,LotShape,Utilities,Neighborhood,BldgType,HouseStyle,ExterQual' AS categorical_columns
FROM listing"""))
def profile_shape(spark, sf):
    return pf.profile_shape(listing(spark, sf).select(*LISTING_COLS))


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0::DOUBLE / CAST(count(*) AS DOUBLE), 2) AS missing_pct "
    f"FROM dirty_listing" for c in LISTING_COLS)


@register("missing_report", "A2 A3 F4", with_dirty_listing(f"""
SELECT * FROM ({_MISSING_SQL}) t WHERE missing > 0"""))
def missing_report(spark, sf):
    return pf.missing_report(dirty_listing(spark, sf).select(*LISTING_COLS))


@register("duplicate_count", "A4", with_dirty_listing("""
SELECT CAST((SELECT count(*) FROM dirty_listing) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_listing) d)
       AS BIGINT) AS duplicates"""))
def duplicate_count(spark, sf):
    return pf.duplicate_count(dirty_listing(spark, sf))


@register("numeric_describe", "A5 A11", with_listing(f"""
SELECT feature AS "column", count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
       round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS "max"
FROM {_unpivot_sql(NUM_T)} GROUP BY feature"""))
def numeric_describe(spark, sf):
    d = pf.numeric_describe(listing(spark, sf), list(NUM_T))
    return _round_cols(d, ("mean", "std", "min", "q25", "q50", "q75", "max"))


@register("target_stats", "A6", with_listing("""
SELECT round(avg(CAST(SalePrice AS DOUBLE)), 6) AS mean, round(median(CAST(SalePrice AS DOUBLE)), 6) AS median,
       round(stddev_samp(CAST(SalePrice AS DOUBLE)), 6) AS std, CAST(min(SalePrice) AS DOUBLE) AS "min",
       CAST(max(SalePrice) AS DOUBLE) AS "max", round(skewness(CAST(SalePrice AS DOUBLE)), 6) AS skewness,
       round(kurtosis(CAST(SalePrice AS DOUBLE)), 6) AS kurtosis
FROM listing"""))
def target_stats(spark, sf):
    t = pf.target_stats(listing(spark, sf), "SalePrice")
    return _round_cols(t, ("mean", "median", "std", "skewness", "kurtosis"))


@register("skew_scan", "A9", with_listing(f"""
SELECT feature AS "column", round(skewness(v), 6) AS skewness FROM {_unpivot_sql(NUM_T)} GROUP BY feature"""))
def skew_scan(spark, sf):
    return _round_cols(pf.skew_scan(listing(spark, sf), list(NUM_T)), ("skewness",))


@register("quartiles", "A11", with_listing(f"""
SELECT feature AS "column", quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
       quantile_cont(v, 0.75) AS q75
FROM {_unpivot_sql(NUM_T)} GROUP BY feature"""))
def quartiles(spark, sf):
    return pf.quartiles(listing(spark, sf), list(NUM_T))


@register("corr_with_target", "A12", with_listing(f"""
SELECT feature AS "column", round(corr(v, CAST(SalePrice AS DOUBLE)), 6) AS corr
FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUM)}, CAST(SalePrice AS DOUBLE) AS y,
               SalePrice FROM listing) ON {', '.join(_NUM)}, y INTO NAME feature VALUE v)
GROUP BY feature"""))
def corr_with_target(spark, sf):
    out = pf.corr_with_target(listing(spark, sf).select(*NUM_T), "SalePrice", list(NUM_T))
    out = out.withColumn("column", F.when(F.col("column") == "SalePrice", "y").otherwise(F.col("column")))
    return _round_cols(out, ("corr",))


CORR_TOP_N = 15


@register("corr_matrix_top", "A13", with_listing(f"""
, u AS (SELECT id, feature, v FROM (UNPIVOT (SELECT id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUM_T)}
          FROM listing) ON {', '.join(NUM_T)} INTO NAME feature VALUE v)),
  y AS (SELECT id, CAST(SalePrice AS DOUBLE) AS y FROM listing),
  r AS (SELECT feature, abs(corr(u.v, y.y)) AS a FROM u JOIN y USING (id) GROUP BY feature),
  top AS (SELECT feature FROM r ORDER BY round(a, 10) DESC, feature LIMIT {CORR_TOP_N})
SELECT a.feature AS col_i, b.feature AS col_j, round(corr(a.v, b.v), 6) AS corr
FROM u a JOIN u b ON a.id = b.id AND a.feature > b.feature
WHERE a.feature IN (SELECT feature FROM top) AND b.feature IN (SELECT feature FROM top)
GROUP BY a.feature, b.feature""".replace("\n, u AS", ",\nu AS", 1)))
def corr_matrix_top(spark, sf):
    out = pf.corr_matrix_top(listing(spark, sf).select(*NUM_T), "SalePrice", CORR_TOP_N)
    return out.select(F.greatest("col_i", "col_j").alias("col_i"), F.least("col_i", "col_j").alias("col_j"),
                      _r("corr").alias("corr"))


_MINMAX = "mm AS (SELECT CAST(min(SalePrice) AS DOUBLE) AS lo, CAST(max(SalePrice) AS DOUBLE) AS hi FROM listing)"


@register("price_range_bins", "A14", with_listing(f""",
{_MINMAX}
SELECT CAST(least(5, greatest(1, CAST(ceil((SalePrice - lo) / ((hi - lo) / 5.0::DOUBLE)) AS INTEGER))) AS INTEGER)
       AS range_bin, count(*) AS "count"
FROM listing CROSS JOIN mm GROUP BY 1"""))
def price_range_bins(spark, sf):
    from ..operators.evaluate import range_bins
    b, _, _ = range_bins(listing(spark, sf), "SalePrice", 5)
    return b.groupBy("range_bin").agg(F.count(F.lit(1)).alias("count"))


@register("histogram_50", "A16", with_listing(f""",
{_MINMAX},
c AS (SELECT CAST(least(50, CAST(floor((SalePrice - lo) / ((hi - lo) / 50.0::DOUBLE)) AS INTEGER) + 1) AS INTEGER) AS bin,
             count(*) AS n FROM listing CROSS JOIN mm GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * ((hi - lo) / 50.0::DOUBLE), 6) AS bin_lo,
       round(lo + b * ((hi - lo) / 50.0::DOUBLE), 6) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS "count"
FROM range(1, 51) r(b) CROSS JOIN mm LEFT JOIN c ON c.bin = r.b"""))
def histogram_50(spark, sf):
    return _round_cols(pf.histogram(listing(spark, sf), "SalePrice", 50), ("bin_lo", "bin_hi"))


@register("boxplot_stats", "A17", with_listing("""
, q AS (SELECT ExterQual, count(SalePrice) AS n, quantile_cont(CAST(SalePrice AS DOUBLE), 0.25) AS q1,
               quantile_cont(CAST(SalePrice AS DOUBLE), 0.5) AS median, quantile_cont(CAST(SalePrice AS DOUBLE), 0.75) AS q3
        FROM listing GROUP BY ExterQual),
  f AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS flo, q3 + 1.5::DOUBLE * (q3 - q1) AS fhi FROM q)
SELECT f.ExterQual, f.n, f.q1, f.median, f.q3,
       min(CASE WHEN l.SalePrice >= flo AND l.SalePrice <= fhi THEN CAST(l.SalePrice AS DOUBLE) END) AS whisker_lo,
       max(CASE WHEN l.SalePrice >= flo AND l.SalePrice <= fhi THEN CAST(l.SalePrice AS DOUBLE) END) AS whisker_hi,
       CAST(sum(CASE WHEN l.SalePrice >= flo AND l.SalePrice <= fhi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM f JOIN listing l ON l.ExterQual = f.ExterQual
GROUP BY f.ExterQual, f.n, f.q1, f.median, f.q3""".replace("\n, q AS", ",\nq AS", 1)))
def boxplot_stats(spark, sf):
    return pf.boxplot_stats(listing(spark, sf), "SalePrice", "ExterQual")


@register("group_median_order", "A18", with_listing("""
SELECT Neighborhood, median(CAST(SalePrice AS DOUBLE)) AS median_target FROM listing GROUP BY Neighborhood"""))
def group_median_order(spark, sf):
    return pf.group_median_order(listing(spark, sf), "Neighborhood")


@register("value_counts_top", "A19", with_listing("""
SELECT HouseStyle, count(*) AS "count" FROM listing GROUP BY HouseStyle ORDER BY 2 DESC, 1 LIMIT 8"""))
def value_counts_top(spark, sf):
    return pf.value_counts_top(listing(spark, sf), "HouseStyle", 8)


def _split_sql():
    return f"CASE WHEN {bucket_sql('id', 10000, 42)} < 2000 THEN 'test' ELSE 'train' END"


@register("split_target_stats", "A29", with_listing(f"""
SELECT {_split_sql()} AS split, count(*) AS n, CAST(min(SalePrice) AS DOUBLE) AS min_target,
       CAST(max(SalePrice) AS DOUBLE) AS max_target, round(avg(CAST(SalePrice AS DOUBLE)), 6) AS mean_target
FROM listing GROUP BY 1"""))
def split_target_stats(spark, sf):
    return _round_cols(pf.split_target_stats(assign_split(listing(spark, sf))), ("mean_target",))


@register("head_n", "F7", with_listing("SELECT * EXCLUDE (SalePrice), SalePrice FROM listing ORDER BY id LIMIT 5"))
def head_n(spark, sf):
    return pf.head_n(listing(spark, sf), 5, "id")


def _hist_sql(src: str, col: str, bins: int, stage: str) -> str:
    return f"""(SELECT '{stage}' AS stage, '{col}' AS "column", CAST(b AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS "count"
  FROM range(1, {bins + 1}) r(b) LEFT JOIN (
    SELECT CAST(least({bins}, CAST(floor((CAST({col} AS DOUBLE) - lo) / ((hi - lo) / {bins}.0::DOUBLE)) AS INTEGER) + 1) AS INTEGER) AS bin,
           count(*) AS n
    FROM {src}, (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src}) mm
    WHERE {col} IS NOT NULL GROUP BY 1) c ON c.bin = r.b)"""


_COMPARED = ("GrLivArea", "LotArea", "GarageArea")


@register("imputation_compare", "A30 T1", with_dirty_listing(f""",
med AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in _COMPARED)} FROM dirty_listing),
imputed AS (SELECT {", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _COMPARED)} FROM dirty_listing, med)
""" + " UNION ALL ".join(_hist_sql(src, c, 30, stage) for c in _COMPARED
                         for src, stage in (("dirty_listing", "before"), ("imputed", "after")))))
def imputation_compare(spark, sf):
    """Histograms of three columns before and after imputation."""
    d = cut_lineage(dirty_listing(spark, sf).select(*_COMPARED))
    return pf.imputation_compare(d, cl.fit_imputer(d, strategy="median").transform(d), list(_COMPARED), 30)


# ----------------------------------------------------------------- cleaning

_IQR_COLS = ("LotArea", "GrLivArea", "TotalBsmtSF", "GarageArea")


def _iqr_chain_sql(src: str, threshold: str = "3.0::DOUBLE") -> str:
    parts, prev = [], src
    for i, c in enumerate(_IQR_COLS, 1):
        parts.append(f"b{i} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
                     f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {prev})")
        parts.append(f"s{i} AS (SELECT {prev}.* FROM {prev}, b{i} WHERE {c} >= q1 - {threshold} * (q3 - q1) "
                     f"AND {c} <= q3 + {threshold} * (q3 - q1))")
        prev = f"s{i}"
    return ",\n".join(parts)


@register("outlier_iqr", "F1 J3", with_dirty_listing(",\n" + _iqr_chain_sql("dirty_listing") + """
SELECT id, LotArea, GrLivArea, TotalBsmtSF, GarageArea FROM s4"""))
def outlier_iqr(spark, sf):
    out = cl.remove_outliers_iqr(dirty_listing(spark, sf), list(_IQR_COLS), 3.0)
    return out.select("id", *_IQR_COLS)


@register("outlier_zscore", "F2 J3", with_dirty_listing(""",
st AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_pop(CAST({c} AS DOUBLE)) AS s{i}"
                            for i, c in enumerate(_IQR_COLS)) + """ FROM dirty_listing)
SELECT id, LotArea, GrLivArea, TotalBsmtSF, GarageArea FROM dirty_listing, st
WHERE """ + " AND ".join(f"abs((CAST({c} AS DOUBLE) - m{i}) / s{i}) < 3.0::DOUBLE" for i, c in enumerate(_IQR_COLS))))
def outlier_zscore(spark, sf):
    out = cl.remove_outliers_zscore(dirty_listing(spark, sf), list(_IQR_COLS), 3.0)
    return out.select("id", *_IQR_COLS)


@register("outlier_report", "F3", with_dirty_listing(",\n" + _iqr_chain_sql("dirty_listing") + """
SELECT b.n AS rows_before, a.n AS rows_after, b.n - a.n AS rows_removed,
       round(CAST(b.n - a.n AS DOUBLE) * 100.0::DOUBLE / CAST(b.n AS DOUBLE), 6) AS pct_removed
FROM (SELECT count(*) AS n FROM dirty_listing) b, (SELECT count(*) AS n FROM s4) a"""))
def outlier_report(spark, sf):
    d = dirty_listing(spark, sf)
    return cl.outlier_report(d, cl.remove_outliers_iqr(d, list(_IQR_COLS), 3.0))


def _range_sql():
    sel, viol = [], []
    for c, (lo, hi, dflt) in cl.INPUT_RANGES.items():
        sel.append(f"coalesce({c}, {dflt}) AS {c}")
        viol.append(f"CASE WHEN coalesce({c}, {dflt}) < {lo} OR coalesce({c}, {dflt}) > {hi} THEN '{c}' END")
    return (f"SELECT id, {', '.join(sel)}, concat_ws(',', {', '.join(viol)}) AS violations FROM dirty_listing")


@register("range_validation", "F6", with_dirty_listing("\n" + _range_sql()))
def range_validation(spark, sf):
    out = cl.validate_ranges(dirty_listing(spark, sf))
    return out.withColumn("violations", F.array_join("violations", ","))


@register("impute_median", "T1", with_dirty_listing(""",
med AS (SELECT """ + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in _NUM) + """ FROM dirty_listing)
SELECT id, """ + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM) + """
FROM dirty_listing, med"""))
def impute_median(spark, sf):
    d = dirty_listing(spark, sf)
    m = cl.fit_imputer(d, strategy="median")
    return m.transform(d).select("id", *_NUM)


_CATS = ("MSZoning", "Street", "LotShape", "Utilities", "Neighborhood", "BldgType", "HouseStyle", "ExterQual")


@register("impute_mode", "T2", with_dirty_listing("\nSELECT id, " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM dirty_listing WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
    for c in _CATS) + " FROM dirty_listing"))
def impute_mode(spark, sf):
    d = dirty_listing(spark, sf)
    m = cl.fit_imputer(d.select("id", *_CATS), strategy="median")
    return m.transform(d.select("id", *_CATS))


CONST_FILL = {"GrLivArea": 0, "LotArea": 0, "MSZoning": "None", "ExterQual": "None"}


@register("impute_constant", "T3", with_dirty_listing("""
SELECT id, coalesce(GrLivArea, 0) AS GrLivArea, coalesce(LotArea, 0) AS LotArea,
       coalesce(MSZoning, 'None') AS MSZoning, coalesce(ExterQual, 'None') AS ExterQual FROM dirty_listing"""))
def impute_constant(spark, sf):
    return cl.fill_constants(dirty_listing(spark, sf), CONST_FILL).select("id", *CONST_FILL)


# ----------------------------------------------------------------- encoding

@register("ordinal_encode", "T4", with_dirty_listing("""
SELECT id, CAST(coalesce(CASE ExterQual WHEN 'Po' THEN 1 WHEN 'Fa' THEN 2 WHEN 'TA' THEN 3 WHEN 'Gd' THEN 4
                         WHEN 'Ex' THEN 5 END, 3) AS INTEGER) AS ExterQual FROM dirty_listing"""))
def ordinal_encode(spark, sf):
    return en.ordinal_encode(dirty_listing(spark, sf).select("id", "ExterQual"))


@register("one_hot_drop_first", "T5 P19", with_dirty_listing("""
SELECT id, """ + ", ".join(
    f"CAST(coalesce(CAST({c} = '{v}' AS INTEGER), 0) AS INTEGER) AS {c}_{v}"
    for c, vals in (("MSZoning", ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), ("LotShape", ("O", "P")))
    for v in vals) + " FROM dirty_listing"))
def one_hot_drop_first(spark, sf):
    d = dirty_listing(spark, sf).select("id", "MSZoning", "LotShape")
    return en.fit_one_hot(d, ["MSZoning", "LotShape"]).transform(d)


_NOMINAL = ("MSZoning", "Street", "LotShape", "Utilities", "Neighborhood", "BldgType", "HouseStyle")


@register("encode_categoricals", "T6 T4 T5 P19", with_listing("""
SELECT id, 'ExterQual' AS feature, CAST(coalesce(CASE ExterQual WHEN 'Po' THEN 1 WHEN 'Fa' THEN 2 WHEN 'TA' THEN 3
       WHEN 'Gd' THEN 4 WHEN 'Ex' THEN 5 END, 3) AS INTEGER) AS value FROM listing
UNION ALL
SELECT id, col || '_' || val AS feature, 1 AS value
FROM (UNPIVOT (SELECT id, """ + ", ".join(_NOMINAL) + """ FROM listing) ON """ + ", ".join(_NOMINAL) + """
      INTO NAME col VALUE val) u
WHERE val > (SELECT min(v2) FROM (UNPIVOT (SELECT """ + ", ".join(_NOMINAL) + """ FROM listing) ON """ + ", ".join(_NOMINAL) + """
      INTO NAME c2 VALUE v2) m WHERE m.c2 = u.col)"""))
def encode_categoricals(spark, sf):
    d = listing(spark, sf).select("id", "ExterQual", *_NOMINAL)
    model = en.fit_categorical_encoder(d)
    enc = model.transform(d)
    names = ["ExterQual"] + model.one_hot.dummy_names()
    long = enc.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("int").alias("value"))
                                                for n in names])).alias("s")).select("id", "s.feature", "s.value")
    return long.filter((F.col("feature") == "ExterQual") | (F.col("value") == 1))


@register("robust_scale", "T8", with_listing(""",
q AS (SELECT """ + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}, "
    f"CASE WHEN quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) = 0 THEN 1.0::DOUBLE "
    f"ELSE quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) END AS s_{c}"
    for c in _NUM) + f" FROM listing WHERE {bucket_sql('id', 10000, 42)} >= 2000)\nSELECT id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS {c}" for c in _NUM) + " FROM listing, q"))
def robust_scale(spark, sf):
    d = listing(spark, sf).select("id", *_NUM)
    train = assign_split(d).filter(F.col("split") == "train")
    model = en.fit_robust_scaler(train, _NUM)
    return _round_cols(model.transform(d), _NUM)


@register("hash_split", "T9", with_listing(f"SELECT id, {_split_sql()} AS split FROM listing"))
def hash_split(spark, sf):
    return assign_split(listing(spark, sf).select("id"))


@register("kfold_assign", "R1 R2", with_listing(
    f"SELECT id, CAST({bucket_sql('id', 5, 43)} AS INTEGER) AS fold FROM listing"))
def kfold_assign(spark, sf):
    return assign_folds(listing(spark, sf).select("id"), k=5)


@register("split_fold_counts", "T9 R1 R3", with_listing(f""",
t AS (SELECT {_split_sql()} AS split, CAST({bucket_sql('id', 5, 43)} AS INTEGER) AS fold,
               {bucket_sql('id', 10000, 44)} / 10000.0::DOUBLE AS share FROM listing)
SELECT split, fold, count(*) AS n, CAST(sum(CASE WHEN share < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n10,
       CAST(sum(CASE WHEN share < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n50 FROM t GROUP BY split, fold"""))
def split_fold_counts(spark, sf):
    """Folds and curve subsets are independent of the split: every cell holds its share."""
    t = with_curve_share(assign_folds(assign_split(listing(spark, sf).select("id"))))
    return t.groupBy("split", "fold").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("curve_share") < 0.1, 1).otherwise(0)).alias("n10"),
        F.sum(F.when(F.col("curve_share") < 0.5, 1).otherwise(0)).alias("n50"))


@register("hash_split_exact", "T9", with_listing(f""",
o AS (SELECT id, row_number() OVER (ORDER BY {mix_key_sql('id', 52)}, id) AS rn,
             count(*) OVER () AS n FROM listing)
SELECT id, CASE WHEN rn <= CAST(round(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM o"""))
def hash_split_exact(spark, sf):
    """Exact test size: the rows with the smallest hashes."""
    from ..operators.split import assign_split_exact
    return assign_split_exact(listing(spark, sf).select("id"))
