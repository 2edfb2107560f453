"""File sources and sinks: CSV scan with NA tokens (S1), CSV/parquet sinks
(S3), train/test pair sink (S4). Paths are shared storage (the session's
checkpoint folder by default), never a machine-local temp folder."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Tokens read as missing (pandas default NA set, the subset
# that can appear in this data).
NA_TOKENS = ("", "NA", "N/A", "NULL", "NaN", "nan", "None", "null", "n/a", "#N/A")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "larkspur-out", f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system, local or not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder from its own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Frees the disk of shuffles that no frame needs any more: Spark deletes their
    files once the driver's JVM has collected what stands for them."""
    gc.collect()
    spark._jvm.System.gc()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_tokens=NA_TOKENS) -> DataFrame:
    """Header row; explicit schema when given (no inference pass at
    scale); every NA token in a text column becomes NULL. Numeric columns
    are read as text first so that tokens such as ``NA`` cannot fail the
    cast, then cast (ANSI-safe ``try_cast``)."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if st is None:
        return _na_to_null(spark.read.option("header", True).option("inferSchema", True).csv(path), na_tokens)
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in st.fields])
    raw = spark.read.schema(as_text).option("header", True).csv(path)
    cols = []
    for f in st.fields:
        c = F.when(F.col(f.name).isin(list(na_tokens)), F.lit(None)).otherwise(F.col(f.name))
        if not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def read_csv_or(spark: SparkSession, path: str, fallback, schema: T.StructType | str | None = None,
                na_tokens=NA_TOKENS) -> DataFrame:
    """S1 with a fallback: the file if it exists in its own file system, else
    the table that ``fallback()`` gives, in the same columns."""
    if path_exists(spark, path):
        return read_csv(spark, path, schema, na_tokens)
    other = fallback()
    if schema is None:
        return other
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return other.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def _na_to_null(df: DataFrame, na_tokens) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(list(na_tokens)), F.lit(None)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, null_token: str = "") -> str:
    """S3: overwrite, header, no index column."""
    df.write.mode("overwrite").option("header", True).option("nullValue", null_token).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by=None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_split_pair(df: DataFrame, path: str, split_col: str = "split") -> str:
    """One write, partitioned by split (train / test sub-folders)."""
    return write_parquet(df, path, split_col)
