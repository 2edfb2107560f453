"""Parquet table access and size-checked broadcast."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Scans smaller than this are never spread. Kept at 0: at runtime AQE may
# broadcast the *larger* side of a small-data join, which makes the small
# table the probe side -- its partition count then sets the parallelism of
# the whole join and everything after it (observed: a one-partition
# customer scan running the full 600k-row listing in one task).
SPREAD_MIN_BYTES = 0
# A side is broadcast only when its row count is proven below this bound.
BROADCAST_MAX_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """Parquet scan. An under-split input (fewer scan partitions than the
    session's parallelism, e.g. one large row group) is hash-spread so every
    core works; a big table already has more splits than cores and is left
    untouched (no extra shuffle at scale). Column pruning and filter
    pushdown still reach the scan through the repartition. Sessions without
    a local JVM handle (Spark Connect) skip the check."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spread:
        try:
            target = spark.sparkContext.defaultParallelism
            splits = df.rdd.getNumPartitions()
        except Exception:  # noqa: BLE001 - no RDD API on this session
            return df
        if target > 1 and splits < target and _plan_bytes(df) >= SPREAD_MIN_BYTES:
            # hash on the leading key column: deterministic on task retry
            # without the pre-sort a round-robin repartition needs
            df = df.repartition(target, df.columns[0])
    return df


def _plan_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a plan (file sizes for a scan)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size) if isinstance(size, int) else int(size.toString())
    except Exception:  # noqa: BLE001 - estimate unavailable: treat as large
        return SPREAD_MIN_BYTES


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        path = os.path.join(sf_dir, f"{n}.parquet")
        if os.path.exists(path):
            read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def bounded_count(df: DataFrame, bound: int) -> int:
    """Row count, computed over at most ``bound + 1`` rows."""
    return df.limit(bound + 1).count()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only behind a checked row count; otherwise the plain
    frame, so the join falls back to a shuffled (sort-merge) join."""
    if bounded_count(df, max_rows) <= max_rows:
        return F.broadcast(df)
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder
    (survives executor loss, unlike a local checkpoint)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def persisted(df: DataFrame, cols=None):
    """A pruned projection kept for the passes of one fit (MEMORY_AND_DISK:
    spills instead of failing, recomputed from lineage if an executor is
    lost) and released afterwards. Of a frame that is kept already, the
    projection alone."""
    src = (df.select(*[F.col(c) for c in dict.fromkeys(cols)]) if cols else df)
    if df.is_cached:
        yield src
        return
    src = src.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield src
    finally:
        src.unpersist()
