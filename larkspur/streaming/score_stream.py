"""Streaming scoring (ST1): new line-item files -> listing rows (stream-static
joins) -> fitted PipelineModel -> parquet sink, exactly-once through the
checkpoint. ``availableNow`` drains what is there and stops, so the same
code serves a scheduled incremental batch and a continuous stream."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.listing import listing
from ..sources.tables import read_table


def stream_source(spark: SparkSession, sf_dir: str, table: str = "lineitem",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    schema = read_table(spark, sf_dir, table).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a glob, so the source's base path is the folder and new files are picked up
    return r.parquet(os.path.join(sf_dir, f"{table}.parque[t]"))


def start_scoring(spark: SparkSession, sf_dir: str, model: PipelineModel, out_path: str,
                  checkpoint: str, keep=("id",), available_now: bool = True, columns=None):
    """``columns``: the fields that reach the model, all by default."""
    rows = listing(spark, sf_dir, stream_source(spark, sf_dir))
    rows = rows.select(*columns) if columns else rows
    price = F.greatest(F.bround("prediction", 2), F.lit(0.0))
    scored = model.transform(rows).select(*keep, F.when(F.col("prediction").isNotNull(), price).alias("PredictedPrice"))
    w = (scored.writeStream.format("parquet").option("path", out_path)
               .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def score_stream(spark: SparkSession, sf_dir: str, model: PipelineModel, out_path: str,
                 checkpoint: str, timeout_s: int = 600, columns=None) -> DataFrame:
    q = start_scoring(spark, sf_dir, model, out_path, checkpoint, columns=columns)
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not drain in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out_path)
