"""Session construction and shared-storage helpers.

On a cluster the session is created by the platform and passed in; the
helpers here only fill gaps (local tests, bench) and never override
settings the cluster already provides.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Shuffle partitions for local runs; on a cluster this comes from the
# cluster config (AQE coalesces small partitions at run time either way).
LOCAL_SHUFFLE_PARTITIONS = 8


def local_session(cpus: int | str = "*", app: str = "larkspur",
                  shuffle_partitions: int = LOCAL_SHUFFLE_PARTITIONS,
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench. UI off, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; that value is always
    used when present. Only in local mode, when nothing is configured, a fresh
    scratch folder is created and registered; on a cluster that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="larkspur-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
