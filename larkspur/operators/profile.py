"""Profiling and EDA aggregates.

Rule of style: every statistic of one report is computed in a single
``agg`` (one scan, partial aggregation per task); reports come back in long
form (one row per column or bin) as small DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import sample_kurtosis, sample_skewness
from ..roles import HOUSING_TARGET, numeric_columns, string_columns
from ..sources.tables import persisted
from .quantiles import at_probability, group_quantiles, quantiles, ranked_values


def _stack(df: DataFrame, row_aliases: dict[str, list[str]], name_col: str = "column") -> DataFrame:
    """Unpivot a one-row frame: for each column name, pick its aggregate aliases."""
    items = list(row_aliases.items())
    n_fields = len(items[0][1])
    structs = [F.struct(F.lit(name).alias(name_col),
                        *[F.col(a).alias(f"f{j}") for j, a in enumerate(aliases)])
               for name, aliases in items]
    return df.select(F.explode(F.array(*structs)).alias("s")).select(
        F.col(f"s.{name_col}").alias(name_col), *[F.col(f"s.f{j}") for j in range(n_fields)])


def profile_shape(df: DataFrame) -> DataFrame:
    """A1: rows, columns, numeric / categorical column counts and lists."""
    num, cat = numeric_columns(df), string_columns(df)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.lit(len(num)).cast("long").alias("n_numeric"),
        F.lit(len(cat)).cast("long").alias("n_categorical"),
        F.lit(",".join(num)).alias("numeric_columns"),
        F.lit(",".join(cat)).alias("categorical_columns"))


def missing_report(df: DataFrame, only_missing: bool = True, sort_by: str = "missing") -> DataFrame:
    """(column, missing, missing_pct rounded to 2) in one pass;
    optionally only columns with missing > 0, sorted descending."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}"))
    one = df.agg(*aggs)
    long = _stack(one.select("*"), {c: [f"m{i}", "_n"] for i, c in enumerate(cols)})
    out = long.select(
        "column", F.coalesce(F.col("f0"), F.lit(0)).cast("long").alias("missing"),
        F.round(F.try_divide(F.coalesce(F.col("f0"), F.lit(0)) * 100.0, F.col("f1")), 2).alias("missing_pct"))
    if only_missing:
        out = out.filter(F.col("missing") > 0)
    return out.orderBy(F.desc("missing" if sort_by == "missing" else "missing_pct"), "column")


def missing_total(df: DataFrame) -> DataFrame:
    return df.agg(sum(F.sum(F.col(c).isNull().cast("long")) for c in df.columns).alias("missing_total"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """A4: rows beyond the first of each group of identical rows. The group
    by all columns partially aggregates before the shuffle, so a heavily
    duplicated row costs one buffer entry per task."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def numeric_describe(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """A5: count, mean, std (ddof 1), min, 25/50/75 % (interpolated), max."""
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    with persisted(df, cols) as src:
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        row = src.agg(*aggs).first()
        q = quantiles(src, cols, [0.25, 0.5, 0.75], exact=exact)
    schema = T.StructType([T.StructField("column", T.StringType())] + [
        T.StructField(n, T.LongType() if n == "count" else T.DoubleType())
        for n in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")])
    rows = [(c, int(row[f"n{i}"]), row[f"a{i}"], row[f"s{i}"], row[f"lo{i}"], *q[c], row[f"hi{i}"])
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, schema)   # one row per column: bounded


def target_stats(df: DataFrame, target: str = HOUSING_TARGET, exact: bool = True) -> DataFrame:
    """Mean, median, std, min, max, skewness, excess kurtosis (corrected)."""
    x = F.col(target).cast("double")
    with persisted(df, [target]) as src:
        r = src.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                    F.max(x).alias("max"), sample_skewness(x).alias("skewness"),
                    sample_kurtosis(x).alias("kurtosis")).first()
        med = quantiles(src, [target], [0.5], exact=exact)[target][0]
    schema = ("mean double, median double, std double, min double, max double, skewness double, "
              "kurtosis double")
    return df.sparkSession.createDataFrame(
        [(r["mean"], med, r["std"], r["min"], r["max"], r["skewness"], r["kurtosis"])], schema)


def group_mean(df: DataFrame, key: str, target: str = HOUSING_TARGET) -> DataFrame:
    """A7."""
    return df.groupBy(key).agg(F.avg(F.col(target).cast("double")).alias("mean_target"),
                               F.count(F.lit(1)).alias("n"))


def skew_scan(df: DataFrame, cols=None) -> DataFrame:
    """Corrected skewness per numeric column in one pass."""
    cols = cols or numeric_columns(df)
    one = df.agg(*[sample_skewness(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)])
    return _stack(one, {c: [f"s{i}"] for i, c in enumerate(cols)}).withColumnRenamed("f0", "skewness")


def quartiles(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Interpolated quartiles per column."""
    cols = cols or numeric_columns(df)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    schema = "column string, q25 double, q50 double, q75 double"
    return df.sparkSession.createDataFrame([(c, *q[c]) for c in cols], schema)


def corr_with_target(df: DataFrame, target: str = HOUSING_TARGET, cols=None) -> DataFrame:
    """Pearson correlation of each numeric column with the target
    (pairwise NULL removal), sorted descending."""
    cols = [c for c in (cols or numeric_columns(df))]
    y = F.col(target).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(cols)])
    return (_stack(one, {c: [f"r{i}"] for i, c in enumerate(cols)}).withColumnRenamed("f0", "corr")
              .orderBy(F.desc_nulls_last("corr"), "column"))


# Correlations of one aggregation, so that its generated code stays short.
CORR_PAIRS = 13


def corr_matrix_top(df: DataFrame, target: str = HOUSING_TARGET, top_n: int = 15,
                    rank_digits: int = 10) -> DataFrame:
    """Top-n columns by |corr| with the target (the target itself is
    first), then all pairs (i > j in that order), a few in each pass over the
    kept columns.
    |corr| is ranked at ``rank_digits`` decimals, ties by name, so exactly
    collinear columns do not swap places on floating-point noise."""
    num = numeric_columns(df)
    schema = "col_i string, col_j string, corr double"
    if not num:
        return df.sparkSession.createDataFrame([], schema)
    with persisted(df, num) as src:
        if target in num:
            ranked = corr_with_target(src, target, num).withColumn("a", F.round(F.abs("corr"), rank_digits))
            top = [r["column"] for r in ranked.orderBy(F.desc_nulls_last("a"), "column").limit(top_n).collect()]
        else:
            top = num[:top_n]
        pairs = [(a, b) for i, a in enumerate(top) for j, b in enumerate(top) if i > j]
        rows = []
        for at in range(0, len(pairs), CORR_PAIRS):
            some = pairs[at:at + CORR_PAIRS]
            one = src.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in some]).first()
            rows += [(a, b, r) for (a, b), r in zip(some, one, strict=True)]
    return df.sparkSession.createDataFrame(rows, schema)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins, left-closed, last bin closed on both ends
    (numpy); a zero-width range gives one bin. Two passes: min/max, then a
    grouped count on the bin index."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    if hi == lo:
        n = df.filter(x.isNotNull()).count()
        return spark.createDataFrame([(1, lo - 0.5, lo + 0.5, n)], "bin int, bin_lo double, bin_hi double, count long")
    w = (hi - lo) / bins
    b = F.least(F.lit(bins), F.floor((x - F.lit(lo)) / F.lit(w)).cast("int") + 1)
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + (F.col("id") - 1) * F.lit(w)).alias("bin_lo"),
        (F.lit(lo) + F.col("id") * F.lit(w)).alias("bin_hi"))
    return (edges.join(counts, "bin", "left")
                 .select("bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                 .orderBy("bin"))


def boxplot_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR (most extreme data inside the
    fences) and outlier count, per group, all from the ranked distinct values:
    one pass over the table, and no group is held by one task."""
    keys = [by] if by else []
    ranked = ranked_values(df.select(*keys, F.col(value).cast("double").alias("v")), keys)
    q = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *[
        at_probability(p).alias(c) for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    q = q.withColumn("fence_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("fence_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    q = q.withColumnRenamed(by, f"_{by}") if by else q
    j = ranked.join(q, ranked[by].eqNullSafe(q[f"_{by}"]), "inner") if by else ranked.crossJoin(F.broadcast(q))
    inside = (F.col("v") >= F.col("fence_lo")) & (F.col("v") <= F.col("fence_hi"))
    stats = ["q1", "median", "q3"]
    return j.groupBy(*keys).agg(
        F.first(q["n"]).alias("n"), *[F.first(c).alias(c) for c in stats],
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.sum(F.when(~inside, ranked["n"]).otherwise(0)).cast("long").alias("n_outliers"))


def group_median_order(df: DataFrame, key: str, target: str = HOUSING_TARGET) -> DataFrame:
    """Group median of the target, sorted descending."""
    return (group_quantiles(df, [key], target, [0.5], ["median_target"]).select(key, "median_target")
            .orderBy(F.desc("median_target"), key))


def value_counts_top(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """Top-n values by count (tie-break by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc_nulls_last(col)).limit(n))


def split_target_stats(df: DataFrame, target: str = HOUSING_TARGET, split_col: str = "split") -> DataFrame:
    """A29."""
    y = F.col(target).cast("double")
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("min_target"),
                                     F.max(y).alias("max_target"), F.avg(y).alias("mean_target"))


def head_n(df: DataFrame, n: int = 5, order_by: str = "id") -> DataFrame:
    """always ordered."""
    return df.orderBy(order_by).limit(n)


def imputation_compare(before: DataFrame, after: DataFrame, cols, bins: int = 30) -> DataFrame:
    """Missing totals and histograms of the imputed columns, before and
    after, tagged by stage and unioned."""
    parts = []
    for stage, frame in (("before", before), ("after", after)):
        for c in cols:
            h = histogram(frame, c, bins).select(F.lit(stage).alias("stage"), F.lit(c).alias("column"),
                                                 "bin", "count")
            parts.append(h)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
