"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret
redaction, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import common, stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("secret_scan", stages.secret_scan_stage),
    ("packing", stages.packing_stage),
]

# Hashes, tokenizers and binomial bounds are beyond SQL: tests/llm compares
# each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    with common.staging() as keep:
        for name, stage in STAGES[:-1]:
            docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
