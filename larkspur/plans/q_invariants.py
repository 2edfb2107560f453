"""Queries that state what must hold of fitted models, so that SQL can check
them: normal equations, leaf means, equality of saved, batch and streamed
scores, shares, sizes of folds and subsets, widths of intervals, NULL prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.hashing import bucket_sql
from ..operators import clean as cl
from ..operators import models as md
from ..operators import pricing as pr
from ..operators.bootstrap import bootstrap_metrics
from ..operators.features import align_features
from ..operators.split import with_curve_share
from ..sources import files
from ..sources.listing import dirty_listing, listing
from ..sources.requests import parse_requests
from ..sources.tables import cut_lineage, persisted, read_table
from ..streaming.score_stream import score_stream
from . import training as tr
from .oracle_base import with_dirty_listing, with_listing
from .q_eval import _REQ_FIELDS, scored
from .q_models import _frame, _lab
from .registry import register

_TRAIN_SQL = f"{bucket_sql('id', 10000, 42)} >= 2000"
_VALUES = ", ".join(f"('{c}')" for c in tr.MODEL_FEATURES)


def _fitted(spark, sf, name):
    train = _frame(spark, sf).filter(F.col("split") == "train")
    return train, md.make_pipeline(name, tr.MODEL_FEATURES, "label", **_lab(train)).fit(train)


@register("ols_normal_equations", "M1", f"SELECT feature, true AS holds FROM (VALUES {_VALUES}, ('intercept')) t(feature)")
def ols_normal_equations(spark, sf):
    """Least squares leaves residuals orthogonal to every feature."""
    train, model = _fitted(spark, sf, "linear_regression")
    rows = model.transform(train).withColumn("_r", F.col("label") - F.col("prediction")).withColumn("intercept", F.lit(1.0))
    names = [*tr.MODEL_FEATURES, "intercept"]
    sums = rows.agg(*[F.struct(F.lit(c).alias("feature"), F.sum(F.col("_r") * F.col(c)).alias("s"),
                               F.sum(F.abs(F.col("_r") * F.col(c))).alias("a")).alias(f"s{i}") for i, c in enumerate(names)])
    long = sums.select(F.explode(F.array(*[f"s{i}" for i in range(len(names))])).alias("e"))
    return long.select("e.feature", (F.abs(F.col("e.s")) <= 1e-4 * F.col("e.a")).alias("holds"))


@register("tree_leaf_means", "M4", with_listing(
    f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatched FROM listing WHERE {_TRAIN_SQL}"))
def tree_leaf_means(spark, sf):
    """A regression tree predicts the mean label of each leaf."""
    train, model = _fitted(spark, sf, "decision_tree")
    leaves = model.transform(train).groupBy("prediction").agg(F.avg("label").alias("mean"), F.count("*").alias("n"))
    off = F.abs(F.col("mean") - F.col("prediction")) > 1e-6 * F.abs(F.col("mean"))
    return leaves.agg(F.sum("n").alias("n"), F.sum(F.when(off, F.col("n")).otherwise(0)).alias("mismatched"))


@register("scores_agree", "S5 S6 M16 M17 ST1", with_listing(
    "SELECT way, count(*) AS n, CAST(0 AS BIGINT) AS mismatched FROM listing, (VALUES ('reloaded'), ('batch'), ('stream')) t(way)"
    " GROUP BY way"))
def scores_agree(spark, sf):
    """A reloaded model, the batch sink and the stream give the fitted model's scores.
    The listing is made once beside the stream's; a way is compared, and what it wrote
    deleted, before the next."""
    price = F.when(F.col("prediction").isNotNull(), F.greatest(F.bround("prediction", 2), F.lit(0.0)))
    saved, sink, out = (files.scratch_path(spark, f"agree-{name}") for name in ("model", "batch", "stream"))
    with persisted(tr.model_frame(listing(spark, sf))) as frame:
        model = tr.scaled_pipeline(frame.filter(F.col("split") == "train"), "linear_regression")
        again = md.load_model(md.save_model(model, saved))
        rows = frame.select("id", *tr.MODEL_FEATURES)
        want = model.transform(rows).select("id", price.alias("want"))
        ways = {"reloaded": (saved, lambda: again.transform(rows).select("id", price.alias("PredictedPrice"))),
                "batch": (sink, lambda: md.predict_batch(model, rows, sink=sink)),
                "stream": (out, lambda: score_stream(spark, sf, model, out + "/data", out + "/checkpoint"))}
        parts = []
        for way, (path, scores) in ways.items():
            parts.append(cut_lineage(scores().select("id", "PredictedPrice").join(want, "id").agg(    # one row
                F.lit(way).alias("way"), F.count("*").alias("n"),
                F.sum(F.when(F.abs(F.col("PredictedPrice") - F.col("want")) <= 0.011, 0).otherwise(1)).alias("mismatched"))))
            files.delete_path(spark, path)
            files.free_shuffles(spark)
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("importance_total", "M14 M15", f"SELECT CAST({len(tr.MODEL_FEATURES)} AS BIGINT) AS features, 1.0::DOUBLE AS total, true AS ranked")
def importance_total(spark, sf):
    """Importances are shares, ranked from large to small."""
    _, model = _fitted(spark, sf, "decision_tree")
    imp = md.feature_importance(model, tr.MODEL_FEATURES, len(tr.MODEL_FEATURES), spark)
    order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "importance"))), lambda x: -x["importance"])
    return imp.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                   (F.array_sort(order) == order).alias("ranked"))


@register("cv_folds", "M9 R1", """
SELECT model, CAST(5 AS INTEGER) AS folds, true AS mean_holds FROM (VALUES ('linear_regression'), ('ridge'), ('lasso')) t(model)""")
def cv_folds(spark, sf):
    """Five fold scores per model, and their mean."""
    train = _frame(spark, sf).filter(F.col("split") == "train")
    out = md.cross_validate(train, tr.MODEL_FEATURES, "label", ("linear_regression", "ridge", "lasso"), k=5)
    mean = F.aggregate("fold_r2", F.lit(0.0), lambda a, x: a + x["r2_score"]) / F.size("fold_r2")
    return out.select("model", F.size("fold_r2").alias("folds"), (F.abs(mean - F.col("cv_mean")) < 1e-9).alias("mean_holds"))


@register("learning_curve_sizes", "R3", with_listing(f"""
SELECT f / 10.0::DOUBLE AS fraction, count(*) AS n FROM listing, range(1, 11) t(f)
WHERE {_TRAIN_SQL} AND {bucket_sql('id', 10000, 44)} / 10000.0::DOUBLE < f / 10.0::DOUBLE GROUP BY f"""))
def learning_curve_sizes(spark, sf):
    """Rows of each training subset."""
    shared = with_curve_share(_frame(spark, sf).filter(F.col("split") == "train"))
    steps = F.array(*[F.lit(i / 10) for i in range(1, 11)])
    held = shared.select(F.explode(F.filter(steps, lambda f: F.col("curve_share") < f)).alias("fraction"))
    return held.groupBy("fraction").agg(F.count("*").alias("n"))


@register("bootstrap_width", "R4", "SELECT true AS plausible")
def bootstrap_width(spark, sf):
    """The 90 % interval of the mean residual is as wide as its standard error says."""
    r = F.col("actual") - F.col("predicted")
    with persisted(scored(spark, sf), ("id", "actual", "predicted")) as rows:    # read twice
        ends = bootstrap_metrics(rows, replicates=100, seed=11).where("metric = 'mean_residual'")
        error = rows.agg((F.stddev_samp(r) / F.sqrt(F.count(r).cast("double"))).alias("se"))
        both = cut_lineage(ends.crossJoin(error))    # one row
    ratio = (F.col("hi") - F.col("lo")) / (2 * 1.6448536269514722 * F.col("se"))
    return both.select(((ratio > 0.75) & (ratio < 1.3)).alias("plausible"))


@register("json_score_bad_bodies", "S8 P26", "SELECT event_id, 'error' AS status, NULL::BIGINT AS HedonicPrice FROM events")
def json_score_bad_bodies(spark, sf):
    """Bodies without any requested field are errors and have no price."""
    schema = ", ".join(f"{c} long" for c in _REQ_FIELDS) + ", Neighborhood string, ExterQual string, BldgType string"
    req = parse_requests(read_table(spark, sf, "events").select("event_id", "props"), "props", schema, key="event_id")
    return pr.hedonic_price(req).select("event_id", "status", "HedonicPrice")


@register("three_column_batch", "P20 M17", with_listing("SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing FROM listing"))
def three_column_batch(spark, sf):
    """A batch with three of the columns scores: absent features are 0."""
    _, model = _fitted(spark, sf, "linear_regression")
    batch = listing(spark, sf).select("id", "GrLivArea", "OverallQual")
    priced = md.predict_batch(model, align_features(batch, tr.MODEL_FEATURES, keep=("id",)))
    return priced.agg(F.count("*").alias("n"), F.sum(F.col("PredictedPrice").isNull().cast("long")).alias("missing"))


_IMPUTED = ("GrLivArea", "LotArea", "GarageArea")


@register("imputation_missing_totals", "A30", with_dirty_listing("\n" + " UNION ALL ".join(
    f"""SELECT 'before' AS stage, '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing FROM dirty_listing
UNION ALL SELECT 'after', '{c}', CAST(0 AS BIGINT)""" for c in _IMPUTED)))
def imputation_missing_totals(spark, sf):
    """Missing values of the imputed columns, before and after."""
    d = cut_lineage(dirty_listing(spark, sf).select(*_IMPUTED))
    after = cl.fit_imputer(d, strategy="median").transform(d)
    parts = [frame.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in _IMPUTED]).select(
        F.lit(stage).alias("stage"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"))
                                                         for c in _IMPUTED])).alias("e")).select("stage", "e.*")
        for stage, frame in (("before", d), ("after", after))]
    return parts[0].unionByName(parts[1])
