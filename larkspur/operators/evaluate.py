"""Regression evaluation on a (key, actual, predicted) table: metrics
(A21-A25), gate (F5), residual columns (P27-P29), error by price range
(A14-A15), residual summary (A26), Q-Q points (A27), prediction post-
processing (P23-P25) and batch mean (A28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import FLOAT64_EPS, currency
from ..functions.normal import with_norm_ppf
from ..sources.tables import cut_lineage
from .quantiles import ranked_values

# The quality gate.
R2_GATE = 0.85
RMSE_GATE = 30000.0


def regression_metrics(df: DataFrame, label: str = "actual", pred: str = "predicted",
                       n_features: int = 1, by=None, rounded: bool = True) -> DataFrame:
    """A21-A25 in one aggregation: r2 (constant truth -> 1 if perfect else
    0), adj_r2, rmse, mae, mape (x100, denominator max(|y|, eps)), mse.
    ``by`` gives per-group metrics (e.g. per split) from the same pass."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    r = y - p
    keys = [by] if isinstance(by, str) else list(by or [])
    a = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(r * r).alias("ss_res"),
        (F.var_pop(y) * F.count(y)).alias("ss_tot"),
        F.avg(F.abs(r)).alias("mae"),
        F.avg(F.abs(r) / F.greatest(F.abs(y), F.lit(FLOAT64_EPS))).alias("mape_raw"))
    n = F.col("n").cast("double")
    r2 = (F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - F.col("ss_res") / F.col("ss_tot")))
    adj = F.lit(1.0) - (F.lit(1.0) - r2) * (n - 1) / F.greatest(n - F.lit(n_features) - 1, F.lit(1.0))
    mse = F.col("ss_res") / n
    rnd = (lambda c, k: F.round(c, k)) if rounded else (lambda c, k: c)
    return a.select(*keys, "n",
                    rnd(r2, 4).alias("r2_score"), rnd(adj, 4).alias("adj_r2"),
                    rnd(F.sqrt(mse), 2).alias("rmse"), rnd(F.col("mae"), 2).alias("mae"),
                    rnd(F.col("mape_raw") * 100, 2).alias("mape"), rnd(mse, 2).alias("mse"))


def metric_gate(metrics: DataFrame, r2_min: float = R2_GATE, rmse_max: float = RMSE_GATE) -> DataFrame:
    """PASS when rounded R2 >= threshold; RMSE gate reported alongside."""
    return metrics.withColumn("r2_gate", F.when(F.col("r2_score") >= r2_min, "PASS").otherwise("FAIL")) \
                  .withColumn("rmse_gate", F.when(F.col("rmse") <= rmse_max, "PASS").otherwise("FAIL"))


def residuals(df: DataFrame, label: str = "actual", pred: str = "predicted", key: str = "id") -> DataFrame:
    """P27-P29 per row."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    r = y - p
    return df.select(key, y.alias("actual"), p.alias("predicted"), r.alias("residual"),
                     F.sqrt(F.abs(r)).alias("sqrt_abs_residual"), F.abs(r).alias("abs_error"),
                     (F.try_divide(F.abs(r), F.abs(y)) * 100).alias("pct_error"))


def residual_summary(df: DataFrame, label: str = "actual", pred: str = "predicted") -> DataFrame:
    """Residual mean and sample std."""
    r = F.col(label).cast("double") - F.col(pred).cast("double")
    return df.agg(F.avg(r).alias("residual_mean"), F.stddev_samp(r).alias("residual_std"))


def range_bins(df: DataFrame, col: str, bins: int = 5) -> tuple[DataFrame, float, float]:
    """Equal-width, right-closed bins; the lowest edge is extended by
    0.1 % of the range (pandas ``cut``). Adds ``range_bin`` 1..bins."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.withColumn("range_bin", F.lit(None).cast("int")), lo, hi
    w = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((x - F.lit(lo)) / F.lit(w)).cast("int")))
    return df.withColumn("range_bin", b), lo, hi


# The names of five value ranges, from low to high.
RANGE_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")


def range_label(col: str, bins: int = 5):
    """The name of a range where there are five, else its number."""
    if bins != len(RANGE_LABELS):
        return F.col(col).cast("string")
    return F.element_at(F.array(*map(F.lit, RANGE_LABELS)), F.col(col))


def error_by_range(df: DataFrame, label: str = "actual", pred: str = "predicted", bins: int = 5) -> DataFrame:
    """Per actual-value range: mean abs error, mean pct error, count;
    empty ranges are emitted with count 0 (left join from the bin list)."""
    binned, lo, hi = range_bins(df, label, bins)
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    agg = binned.groupBy("range_bin").agg(
        F.avg(F.abs(y - p)).alias("mean_abs_error"),
        F.avg(F.try_divide(F.abs(y - p), F.abs(y)) * 100).alias("mean_pct_error"),
        F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    labels = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("range_bin"))
    return (labels.join(agg, "range_bin", "left")
                  .select("range_bin", range_label("range_bin", bins).alias("range_label"), "mean_abs_error",
                          "mean_pct_error", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                  .orderBy("range_bin"))


# Ranks of one value that one row stands for before they are dealt out: a
# residual that a third of the rows share is spread over tasks.
RANKS_AT_ONCE = 100_000


def qq_points(df: DataFrame, label: str = "actual", pred: str = "predicted") -> DataFrame:
    """Every ordered residual against its normal quantile at Filliben's
    position, plus the least-squares line through the points. Ranks come from
    the distributed value ranks: no global sort."""
    r = (F.col(label).cast("double") - F.col(pred).cast("double")).alias("v")
    ranked = ranked_values(df.select(r).where(F.col("v").isNotNull()), [])
    runs = ranked.select("v", "hi", "total", F.explode(F.expr(f"sequence(lo, hi - 1, {RANKS_AT_ONCE}L)")).alias("start"))
    # written: the points, up to RANKS_AT_ONCE times as many, are made twice from the runs. As many
    # parts as a shuffle has, for the size of the runs says little about that of the points
    runs = cut_lineage(runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v", "start"))
    pts = runs.select(
        F.col("v").alias("ordered"), "total",
        F.explode(F.expr(f"sequence(start, least(start + {RANKS_AT_ONCE - 1}L, hi - 1))")).alias("rank"))
    i1, n = F.col("rank") + 1, F.col("total")
    filliben = (F.when(i1 == 1, F.lit(1.0) - F.pow(F.lit(0.5), F.lit(1.0) / n))
                 .when(i1 == n, F.pow(F.lit(0.5), F.lit(1.0) / n))
                 .otherwise((i1 - 0.3175) / (n + 0.365)))
    pts = with_norm_ppf(pts.withColumn("_p", filliben), "_p", "theoretical").select("rank", "theoretical", "ordered")
    line = pts.agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                   F.regr_intercept("ordered", "theoretical").alias("intercept"))
    return pts.crossJoin(line)    # one row beside every point


def clip_round_prediction(df: DataFrame, pred: str = "predicted", mode: str = "single") -> DataFrame:
    """Single scoring clamps at 0 then rounds half-even to 2 places;
    batch rounds then clamps."""
    p = F.col(pred).cast("double")
    if mode == "single":
        out = F.bround(F.greatest(p, F.lit(0.0)), 2)
    else:
        out = F.greatest(F.bround(p, 2), F.lit(0.0))
    # greatest() skips NULL: a missing prediction stays missing
    return df.withColumn(pred, F.when(p.isNotNull(), out))


def price_band(df: DataFrame, pred: str = "predicted") -> DataFrame:
    """Numeric and text band, formatted price, confidence."""
    p = F.col(pred).cast("double")
    return df.withColumn("price_formatted", currency(p)).withColumn(
        "price_range", F.struct((p * 0.9).alias("low"), (p * 1.1).alias("high"),
                                currency(p * 0.9).alias("low_text"), currency(p * 1.1).alias("high_text"))
    ).withColumn("confidence", F.lit("±10%"))


def batch_mean_prediction(df: DataFrame, pred: str = "PredictedPrice") -> DataFrame:
    """A28."""
    return df.agg(F.avg(F.col(pred).cast("double")).alias("mean_prediction"),
                  F.count(F.lit(1)).alias("n"))
