"""M22 as a resumable run."""

from pyspark.sql import functions as F

from larkspur.operators import models as md
from larkspur.plans.train_run import TrainRun


def test_run_resumes_and_scores_raw_rows(spark, sample_df, tmp_path):
    names = ("ridge", "decision_tree")
    grids = {"ridge": {"regParam": [1.0, 10.0]}, "decision_tree": {"maxDepth": [1, 2]}}
    first = TrainRun(sample_df, str(tmp_path / "run"), names=names, folds=3, grids=grids)
    out = first.run()
    assert {"prepared", "steps", "models/ridge", "scores/decision_tree", "folds/linear", "choice", "tuning", "artifact"} <= set(first.computed)
    assert out.scores.count() == 2 and out.fold_scores.count() == 6 and out.best in names
    assert out.tuning.count() == 2
    assert [r.variant for r in out.evaluation.orderBy("variant").collect()] == ["base", "tuned"]
    raw = sample_df.drop("SalePrice")
    a = out.model.transform(raw).select("id", F.round("prediction", 6)).orderBy("id").collect()
    assert len(a) == sample_df.count()

    again = TrainRun(sample_df, str(tmp_path / "run"), names=names, folds=3, grids=grids)
    same = again.run()
    assert again.computed == []
    assert same.model.transform(raw).select("id", F.round("prediction", 6)).orderBy("id").collect() == a
    assert same.best == out.best

    # a run that lost its choice and what follows goes on from there
    for gone in ("choice", "artifact.done"):
        path = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "run" / gone))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    part = TrainRun(sample_df, str(tmp_path / "run"), names=names, folds=3, grids=grids)
    part.run()
    assert part.computed == ["choice", "artifact"]


def test_unknown_grid_stays_untuned(spark, sample_df, tmp_path):
    run = TrainRun(sample_df, str(tmp_path / "run"), names=("linear_regression",), folds=2)
    out = run.run()
    rows = {r.variant: r for r in out.evaluation.collect()}
    assert out.tuning.count() == 0 and abs(rows["base"].r2_score - rows["tuned"].r2_score) < 1e-9
    assert md.select_best(out.scores).first()["model"] == "linear_regression"
