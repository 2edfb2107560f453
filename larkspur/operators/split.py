"""Deterministic train/test split (T9), k-fold assignment (R1/R2) and
learning-curve subsets (R3), all from a keyed hash: no ``randomSplit``, no
global sort, no dependence on the partition layout. Each use has a seed of
its own, so folds and subsets are independent of the split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, bucket, mix_key

SPLIT_SEED = 42
# 10,000 buckets: the test share is honoured to 0.01 %.
SPLIT_BUCKETS = 10_000
# Hash intervals that one counting pass of the exact split tells apart.
EXACT_FANOUT = 4_096


def split_bucket(df: DataFrame, key: str = "id", seed: int = SPLIT_SEED, buckets: int = SPLIT_BUCKETS):
    return bucket(key, buckets, seed)


def assign_split(df: DataFrame, key: str = "id", test_share: float = 0.2, seed: int = SPLIT_SEED,
                 buckets: int = SPLIT_BUCKETS) -> DataFrame:
    """Adds ``split`` in {'train','test'}; a row with bucket < share*buckets is test."""
    limit = int(round(test_share * buckets))
    b = split_bucket(df, key, seed, buckets)
    return df.withColumn("split", F.when(b < F.lit(limit), F.lit("test")).otherwise(F.lit("train")))


def train_test_split(df: DataFrame, key: str = "id", test_share: float = 0.2, seed: int = SPLIT_SEED):
    s = assign_split(df, key, test_share, seed)
    return (s.filter(F.col("split") == "train").drop("split"),
            s.filter(F.col("split") == "test").drop("split"))


def assign_folds(df: DataFrame, key: str = "id", k: int = 5, seed: int = SPLIT_SEED,
                 col: str = "fold") -> DataFrame:
    """Fold in [0, k) from the key hash (a seed of its own keeps folds
    independent of the train/test split)."""
    return df.withColumn(col, bucket(key, k, seed + 1).cast("int"))


def with_curve_share(df: DataFrame, key: str = "id", seed: int = SPLIT_SEED,
                     buckets: int = SPLIT_BUCKETS, col: str = "curve_share") -> DataFrame:
    """R3 without duplication: a per-row share in [0, 1); the subset for
    fraction f is ``curve_share < f`` (nested by construction)."""
    return df.withColumn(col, bucket(key, buckets, seed + 2).cast("double") / float(buckets))


def assign_split_exact(df: DataFrame, key: str = "id", test_share: float = 0.2, seed: int = SPLIT_SEED,
                       fanout: int = EXACT_FANOUT) -> DataFrame:
    """T9 with an exact test size round(test_share * n) for a unique ``key``:
    the rows with the smallest hashes.

    The hash at the cut is found digit by digit: each pass counts the rows of
    the open interval in ``fanout`` parts (at most that many rows reach the
    driver) and descends into the part that holds the cut. 60 bits of hash end
    after ten passes or fewer; rows that share the whole hash are cut by key."""
    h = mix_key(key, seed + 10)
    rows = df.select(h.alias("h"), F.col(key).alias("k")).persist()
    try:
        wanted = int(round(test_share * rows.count()))
        low, width = 0, HASH_RANGE            # the cut lies in [low, low + width)
        while wanted and width > 1:
            step = -(-width // fanout)
            part = F.expr(f"(h - {low}L) div {step}L")
            counts = rows.where((F.col("h") >= low) & (F.col("h") < low + width)).groupBy(part.alias("p")).count().collect()
            for p, n in sorted((r["p"], r["count"]) for r in counts):
                if n >= wanted:
                    low, width = low + p * step, step
                    break
                wanted -= n
        last = None
        if wanted:                            # the wanted-th smallest key among equal hashes
            same = rows.where(F.col("h") == low).orderBy("k").limit(wanted)
            last = same.agg(F.max("k").alias("k")).first()["k"]
    finally:
        rows.unpersist()
    in_test = F.lit(False) if last is None else (h < low) | ((h == low) & (F.col(key) <= F.lit(last)))
    return df.withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))
