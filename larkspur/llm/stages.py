"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All
but the last return the columns of ``documents``; n_chars follows the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash, packing, quality, queries, secret_scan, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT = 80    # near copies in the corpus; the 85 of op2_minhash is of that query's contract alone


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _documents(quality.filter_documents(docs.select(*COLUMNS), common.read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: its smallest doc_id; of its rows
    with one text one stays."""
    found = minhash.near_duplicates(docs, percent=NEAR_PERCENT).where("NOT kept").select("doc_id").distinct()
    left = docs.join(found, "doc_id", "left_anti")
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return _documents(named.union(left.where("doc_id IS NULL")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return _documents(substring.remove_repeats(docs))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    scanned = secret_scan.scan(docs)
    return _documents(scanned.withColumn("text", secret_scan.redact(F.col("text"), F.col("spans"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return queries.packed_digests(docs)
