"""Queries: evaluation on fixed formula predictions (A14-A15, A21-A28,
P23-P30, F5, M11-M13, M17, M20), bootstrap intervals (R4) and JSON request
parsing (S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, bucket_sql, mix_key_sql
from ..functions.normal import norm_ppf_sql
from ..operators import evaluate as ev
from ..operators import pricing as pr
from ..operators.bootstrap import bootstrap_metrics, poisson_weight_sql
from ..operators.split import assign_split
from ..sources.listing import listing
from ..sources.tables import cut_lineage, read_table
from .oracle_base import with_listing
from .q_clean import _round_cols, _split_sql
from .q_features import HEDONIC_SQL, _r
from .registry import register


def scored(spark, sf):
    """listing + hedonic prediction: (id, actual, predicted, ...)."""
    df = pr.hedonic_price(listing(spark, sf))
    return df.withColumn("actual", F.col("SalePrice").cast("double")) \
             .withColumn("predicted", F.col("HedonicPrice").cast("double"))


SCORED_SQL = f""",
scored AS (SELECT *, CAST(SalePrice AS DOUBLE) AS actual, CAST({HEDONIC_SQL} AS DOUBLE) AS predicted,
                  {_split_sql()} AS split FROM listing)"""

_METRICS_SQL = """count(*) AS n,
  round(CASE WHEN var_pop(actual) = 0 THEN CASE WHEN sum((actual - predicted) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
        ELSE 1.0::DOUBLE - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(actual)) END, 4) AS r2_score,
  round(1.0::DOUBLE - (1.0::DOUBLE - (CASE WHEN var_pop(actual) = 0 THEN CASE WHEN sum((actual - predicted) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
        ELSE 1.0::DOUBLE - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(actual)) END))
        * (count(*) - 1) / greatest(count(*) - 13 - 1, 1), 4) AS adj_r2,
  round(sqrt(avg((actual - predicted) ^ 2)), 2) AS rmse,
  round(avg(abs(actual - predicted)), 2) AS mae,
  round(avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)) * 100, 2) AS mape,
  round(avg((actual - predicted) ^ 2), 2) AS mse"""


@register("regression_metrics", "A21 A22 A23 A24 A25", with_listing(SCORED_SQL + f"""
SELECT split, {_METRICS_SQL} FROM scored GROUP BY split"""))
def regression_metrics(spark, sf):
    s = assign_split(scored(spark, sf))
    return ev.regression_metrics(s, n_features=13, by="split")


@register("metric_gate", "F5", with_listing(SCORED_SQL + f"""
, m AS (SELECT {_METRICS_SQL} FROM scored)
SELECT *, CASE WHEN r2_score >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS r2_gate,
          CASE WHEN rmse <= 30000 THEN 'PASS' ELSE 'FAIL' END AS rmse_gate FROM m"""))
def metric_gate(spark, sf):
    return ev.metric_gate(ev.regression_metrics(scored(spark, sf), n_features=13))


@register("residuals", "P27 P28 P29", with_listing(SCORED_SQL + """
SELECT id, actual, predicted, actual - predicted AS residual, round(sqrt(abs(actual - predicted)), 6) AS sqrt_abs_residual,
       abs(actual - predicted) AS abs_error,
       round(CASE WHEN actual = 0 THEN NULL ELSE abs(actual - predicted) / abs(actual) END * 100, 6) AS pct_error
FROM scored"""))
def residuals(spark, sf):
    return _round_cols(ev.residuals(scored(spark, sf)), ("sqrt_abs_residual", "pct_error"))


@register("residual_summary", "A26", with_listing(SCORED_SQL + """
SELECT round(avg(actual - predicted), 6) AS residual_mean, round(stddev_samp(actual - predicted), 6) AS residual_std
FROM scored"""))
def residual_summary(spark, sf):
    return _round_cols(ev.residual_summary(scored(spark, sf)), ("residual_mean", "residual_std"))


@register("error_by_price_range", "A15 A14", with_listing(SCORED_SQL + """,
mm AS (SELECT min(actual) AS lo, max(actual) AS hi FROM scored),
b AS (SELECT CAST(least(5, greatest(1, CAST(ceil((actual - lo) / ((hi - lo) / 5.0::DOUBLE)) AS INTEGER))) AS INTEGER) AS range_bin,
             actual, predicted FROM scored, mm),
g AS (SELECT range_bin, avg(abs(actual - predicted)) AS mae,
             avg(CASE WHEN actual = 0 THEN NULL ELSE abs(actual - predicted) / abs(actual) END * 100) AS mpe,
             count(*) AS n FROM b GROUP BY range_bin)
SELECT CAST(r.b AS INTEGER) AS range_bin,
       (['Very Low', 'Low', 'Medium', 'High', 'Very High'])[r.b] AS range_label, round(g.mae, 6) AS mean_abs_error, round(g.mpe, 6) AS mean_pct_error,
       CAST(coalesce(g.n, 0) AS BIGINT) AS "count"
FROM range(1, 6) r(b) LEFT JOIN g ON g.range_bin = r.b"""))
def error_by_price_range(spark, sf):
    return _round_cols(ev.error_by_range(scored(spark, sf), bins=5), ("mean_abs_error", "mean_pct_error"))


@register("qq_points", "A27", with_listing(SCORED_SQL + f""",
r AS (SELECT actual - predicted AS r FROM scored),
n AS (SELECT count(*) AS n FROM r),
pts AS (SELECT CAST(row_number() OVER (ORDER BY r) - 1 AS BIGINT) AS rank, r AS ordered FROM r),
q AS (SELECT rank, ordered,
             CASE WHEN rank = 0 THEN 1.0 - pow(0.5, 1.0 / n) WHEN rank = n - 1 THEN pow(0.5, 1.0 / n)
                  ELSE (rank + 1 - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM pts, n),
th AS (SELECT rank, ordered, {norm_ppf_sql('p')} AS theoretical FROM q),
line AS (SELECT regr_slope(ordered, theoretical) AS slope, regr_intercept(ordered, theoretical) AS intercept FROM th)
SELECT rank, round(theoretical, 6) AS theoretical, round(ordered, 6) AS ordered, round(slope, 4) AS slope,
       round(intercept, 4) AS intercept FROM th, line"""))
def qq_points(spark, sf):
    q = ev.qq_points(scored(spark, sf))
    return q.select("rank", _r("theoretical").alias("theoretical"), _r("ordered").alias("ordered"),
                    _r("slope", 4).alias("slope"), _r("intercept", 4).alias("intercept"))


@register("batch_mean_prediction", "A28", with_listing(SCORED_SQL + """
SELECT round(avg(predicted), 6) AS mean_prediction, count(*) AS n FROM scored"""))
def batch_mean_prediction(spark, sf):
    return _round_cols(ev.batch_mean_prediction(scored(spark, sf), "predicted"), ("mean_prediction",))


RAW_P_SQL = "(CAST(SalePrice AS DOUBLE) / 7.0::DOUBLE - 30000.0::DOUBLE)"


def _raw_p():
    return F.col("SalePrice").cast("double") / 7.0 - 30000.0


@register("clip_round_prediction", "P23", with_listing(f"""
SELECT id, round_even(greatest({RAW_P_SQL}, 0.0::DOUBLE), 2) AS single,
       greatest(round_even({RAW_P_SQL}, 2), 0.0::DOUBLE) AS batch FROM listing"""))
def clip_round_prediction(spark, sf):
    d = listing(spark, sf).select("id", _raw_p().alias("single"), _raw_p().alias("batch"))
    d = ev.clip_round_prediction(d, "single", "single")
    return ev.clip_round_prediction(d, "batch", "batch")


@register("price_band", "P24", with_listing(SCORED_SQL + """
SELECT id, round(predicted * 0.9::DOUBLE, 6) AS low, round(predicted * 1.1::DOUBLE, 6) AS high,
       '$' || format('{:,.2f}', predicted * 0.9::DOUBLE) AS low_text,
       '$' || format('{:,.2f}', predicted * 1.1::DOUBLE) AS high_text, '±10%' AS confidence
FROM scored"""))
def price_band(spark, sf):
    b = ev.price_band(scored(spark, sf))
    return b.select("id", _r("price_range.low").alias("low"), _r("price_range.high").alias("high"),
                    "price_range.low_text", "price_range.high_text", "confidence")


@register("currency_format", "P25", with_listing(f"""
SELECT id, '$' || format('{{:,.2f}}', {RAW_P_SQL}) AS price_text FROM listing"""))
def currency_format(spark, sf):
    from ..functions.numeric import currency
    return listing(spark, sf).select("id", currency(_raw_p()).alias("price_text"))


@register("target_skew_compare", "P30 A9", with_listing("""
SELECT round(skewness(CAST(SalePrice AS DOUBLE)), 6) AS skew_target,
       round(skewness(ln(1 + CAST(SalePrice AS DOUBLE))), 6) AS skew_log_target FROM listing"""))
def target_skew_compare(spark, sf):
    from ..functions.moments import sample_skewness
    y = F.col("SalePrice").cast("double")
    return listing(spark, sf).agg(_r(sample_skewness(y)).alias("skew_target"),
                                  _r(sample_skewness(F.log1p(y))).alias("skew_log_target"))


# ------------------------------------------------- fixed-formula predictors

LINEAR_COEF = {"GrLivArea": 95.3, "OverallQual": 21000.7, "LotArea": 1.1}
LINEAR_INTERCEPT = -50000.0


def _linear_sql():
    return f"({LINEAR_INTERCEPT!r}::DOUBLE + " + " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in LINEAR_COEF.items()) + ")"


def _linear_col():
    out = F.lit(LINEAR_INTERCEPT)
    for c, w in LINEAR_COEF.items():
        out = out + F.col(c) * F.lit(w)
    return out


PREDICTORS_SQL = SCORED_SQL + f""",
tm AS (SELECT avg(actual) AS m FROM scored WHERE split = 'train'),
preds AS (
  SELECT 'hedonic' AS model, 1 AS ordinal, split, actual, predicted FROM scored
  UNION ALL SELECT 'linear_fixed', 2, split, actual, {_linear_sql()} FROM scored
  UNION ALL SELECT 'train_mean', 3, split, actual, tm.m FROM scored, tm
  UNION ALL SELECT 'hedonic_flat', 4, split, actual, CAST(SalePrice AS DOUBLE) * 0.0::DOUBLE + predicted / 1.1::DOUBLE FROM scored),
per AS (SELECT model, ordinal, split,
          CASE WHEN var_pop(actual) = 0 THEN CASE WHEN sum((actual - predicted) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
               ELSE 1.0::DOUBLE - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(actual)) END AS r2,
          sqrt(avg((actual - predicted) ^ 2)) AS rmse
        FROM preds GROUP BY model, ordinal, split),
rk AS (SELECT t.model, t.ordinal, round(tr.r2, 4) AS train_r2, round(t.r2, 4) AS test_r2, round(t.rmse, 2) AS test_rmse,
              round(round(tr.r2, 4) - round(t.r2, 4), 4) AS r2_gap
       FROM per t JOIN per tr ON t.model = tr.model AND t.split = 'test' AND tr.split = 'train')"""


def _predictor_table(spark, sf):
    s = cut_lineage(assign_split(scored(spark, sf)))
    mean_train = s.filter(F.col("split") == "train").agg(F.avg("actual")).first()[0]
    preds = {
        "hedonic": (1, F.col("predicted")),
        "linear_fixed": (2, _linear_col()),
        "train_mean": (3, F.lit(mean_train)),
        "hedonic_flat": (4, F.col("predicted") / F.lit(1.1)),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(o).alias("ordinal"), e.cast("double").alias("p"))
                    for k, (o, e) in preds.items()])
    return s.select("split", "actual", F.explode(arr).alias("m")).select(
        "m.model", "m.ordinal", "split", "actual", F.col("m.p").alias("predicted"))


def _ranking(spark, sf):
    from ..operators.models import results_table
    long = _predictor_table(spark, sf)
    m = ev.regression_metrics(long, by=["model", "ordinal", "split"], rounded=False)
    return results_table(m)


@register("model_ranking", "M12 M13", with_listing(PREDICTORS_SQL + """
SELECT * FROM rk"""))
def model_ranking(spark, sf):
    return _ranking(spark, sf)


@register("select_best", "M11", with_listing(PREDICTORS_SQL + """
SELECT model, test_r2 FROM rk ORDER BY test_r2 DESC, ordinal LIMIT 1"""))
def select_best(spark, sf):
    from ..operators.models import select_best as sb
    return sb(_ranking(spark, sf), "test_r2").select("model", "test_r2")


@register("batch_score_linear", "M17 P23 A28", with_listing(f"""
SELECT id, GrLivArea, OverallQual, LotArea, greatest(round_even({_linear_sql()}, 2), 0.0::DOUBLE) AS PredictedPrice
FROM listing"""))
def batch_score_linear(spark, sf):
    d = listing(spark, sf).select("id", "GrLivArea", "OverallQual", "LotArea")
    d = d.withColumn("PredictedPrice", _linear_col())
    return ev.clip_round_prediction(d, "PredictedPrice", "batch")


@register("linear_contributions", "M20", with_listing(""",
mu AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}" for c in LINEAR_COEF) + """ FROM listing)
SELECT id, """ + ", ".join(f"round({w!r}::DOUBLE * (CAST({c} AS DOUBLE) - m_{c}), 6) AS contrib_{c}"
                           for c, w in LINEAR_COEF.items()) + """,
       round(""" + f"{LINEAR_INTERCEPT!r}::DOUBLE + " + " + ".join(f"{w!r}::DOUBLE * m_{c}" for c, w in LINEAR_COEF.items())
    + """, 6) AS base_value FROM listing, mu"""))
def linear_contributions(spark, sf):
    from ..operators.models import linear_contributions as lc
    d = listing(spark, sf)
    out = lc(d, LINEAR_COEF, LINEAR_INTERCEPT, key="id")
    return _round_cols(out, [f"contrib_{c}" for c in LINEAR_COEF] + ["base_value"])


# ----------------------------------------------------------------- bootstrap

BOOT_REPLICATES = 100


@register("bootstrap_ci", "R4", with_listing(SCORED_SQL + f""",
w AS (SELECT b, actual, predicted,
        (CAST({mix_key_sql('id', "'7/' || b")} AS DOUBLE) + 0.5::DOUBLE) / {float(HASH_RANGE)!r}::DOUBLE AS u
      FROM scored, range(1, {BOOT_REPLICATES + 1}) t(b)),
pw AS (SELECT b, actual, predicted, {poisson_weight_sql('u')} AS wt FROM w),
rep AS (SELECT b, sum(wt * (actual - predicted)) / sum(wt) AS mean_residual,
               sqrt(sum(wt * (actual - predicted) ^ 2) / sum(wt)) AS rmse,
               1.0 - sum(wt * (actual - predicted) ^ 2) / (sum(wt * actual * actual) - sum(wt * actual) ^ 2 / sum(wt)) AS r2
        FROM pw GROUP BY b)
SELECT 'mean_residual' AS metric, round(quantile_cont(mean_residual, 0.05), 4) AS lo,
       round(quantile_cont(mean_residual, 0.95), 4) AS hi FROM rep
UNION ALL SELECT 'rmse', round(quantile_cont(rmse, 0.05), 4), round(quantile_cont(rmse, 0.95), 4) FROM rep
UNION ALL SELECT 'r2', round(quantile_cont(r2, 0.05), 4), round(quantile_cont(r2, 0.95), 4) FROM rep"""))
def bootstrap_ci(spark, sf):
    out = bootstrap_metrics(scored(spark, sf), replicates=BOOT_REPLICATES, seed=7)
    return out.select("metric", _r("lo", 4).alias("lo"), _r("hi", 4).alias("hi"))


# --------------------------------------------------------------- requests

@register("json_request_parse", "S8", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CASE WHEN json_extract(props, '$.k') IS NULL THEN 'error' ELSE 'ok' END AS status
FROM events""")
def json_request_parse(spark, sf):
    from ..sources.requests import parse_requests
    ev_df = read_table(spark, sf, "events").select("event_id", "props")
    return parse_requests(ev_df, "props", "k long", key="event_id").select("event_id", "k", "status")


_REQ_FIELDS = ("LotArea", "YearBuilt", "YearRemodAdd", "TotalBsmtSF", "GrLivArea", "FullBath", "HalfBath",
               "BedroomAbvGr", "TotRmsAbvGrd", "GarageArea", "PoolArea", "OverallQual", "OverallCond")


@register("json_score_response", "S8 P26 M16", with_listing(f"""
SELECT id, 'ok' AS status, {HEDONIC_SQL} AS HedonicPrice,
       json_object('status', 'ok', 'predicted_price', {HEDONIC_SQL})::VARCHAR AS response
FROM listing"""))
def json_score_response(spark, sf):
    """Request bodies (JSON text built from listing rows) -> parsed with an
    explicit schema -> priced -> JSON response text, all in one plan."""
    from ..sources.requests import parse_requests
    d = listing(spark, sf)
    body = d.select("id", F.to_json(F.struct(*_REQ_FIELDS, "Neighborhood", "ExterQual", "BldgType")).alias("body"))
    schema = ", ".join(f"{c} long" for c in _REQ_FIELDS) + ", Neighborhood string, ExterQual string, BldgType string"
    req = parse_requests(body, "body", schema, key="id")
    priced = pr.hedonic_price(req)
    return priced.select("id", "status", "HedonicPrice",
                         F.to_json(F.struct(F.col("status"), F.col("HedonicPrice").alias("predicted_price")))
                         .alias("response"))
