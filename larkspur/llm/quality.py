"""Quality rules with risk-controlled thresholds.

Each rule is a score of a document; a document whose score exceeds the rule's
cutoff is rejected. Cutoffs are chosen per stratum (language by default) on
the labelled documents as a holdout: an exact binomial (Clopper-Pearson)
bound certifies that a cutoff rejects at most ``risk / rules`` of the good
documents, at a level ``delta`` divided by the number of (rule, stratum)
tests (Bonferroni). Cutoffs are tested from lenient to strict and testing
stops at the first failure, so many cutoffs need no further correction. Of
the certified cutoffs the one that best separates the labels is used. A
stratum with too few labels to certify anything rejects nothing.

Defined results: null text counts as no words; a null stratum is a stratum of
its own; repeated rows are judged alike; documents without a label take part
in nothing but the verdict; a document labelled both good and bad counts as
good; an empty label table leaves only the base rules; input columns named
like a feature are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import WordHashes, windows

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK = 0.05          # share of good documents of a stratum that all rules together may reject
DELTA = 0.1         # chance that any of the certificates is wrong
GOOD_WEIGHT = 20.0   # rejecting this share less of the bad is worth one share of the good
BUCKETS = 1000       # scores are shares, kept in steps of 1/BUCKETS

SYMBOLS = b"#*$%&|<>"
_NOT_WORD_POINTS = common.SPACE + bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

FEATURES = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_bangs")])

# rule -> (part, whole): the score is part / whole, at most 1
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "bangs": ("n_bangs", "n_words"),
}


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    h = windows(hashes, width)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_features(text: bytes, words: WordHashes) -> tuple:
    tokens = text.split()
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    size = len(text)
    return (len(tokens), len(text.translate(None, _NOT_WORD_POINTS)), size - len(text.translate(None, SYMBOLS)),
            dup, repeated_words(words.of(tokens)), lines, size - len(text.translate(None, _CAPITALS)),
            text.count(b"!"))


def add_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Feature counts of every whole text beside the kept columns."""
    def compute(batch):
        words = _words()
        rows = [text_features(t, words) for t in common.byte_texts(common.column(batch, text))]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FEATURES.fields]
    return common.with_columns(docs, FEATURES, compute, keep)


_cache: list[WordHashes] = []


def _words() -> WordHashes:
    if not _cache:
        _cache.append(WordHashes())
    return _cache[0]


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def bucket(rule: str) -> Column:
    part, whole = RULES[rule]
    share = F.least(F.lit(BUCKETS), F.floor(F.lit(float(BUCKETS)) * F.col(part) / F.col(whole)))
    return F.when(F.col(whole) > 0, share).otherwise(F.lit(0)).cast("int")


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(X <= x) for X ~ Binomial(n, p), through the incomplete beta function."""
    if x < 0:
        return 0.0
    if x >= n:
        return 1.0
    return _beta_share(n - x, x + 1, 1.0 - p)


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a)
                     - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 10_000_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (max(abs(1 + term * d), tiny) * (1 if 1 + term * d >= 0 else -1))
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-13:
            break
    return front * total


def most_rejections(n: int, share: float, level: float) -> int:
    """The most false rejections x among n whose upper confidence bound at
    ``level`` is still at most ``share``; -1 if not even 0 suffices."""
    low, high = -1, n - 1 if n else -1
    while low < high:
        mid = (low + high + 1) // 2
        if binomial_cdf(mid, n, share) <= level:
            low = mid
        else:
            high = mid - 1
    return low


def choose_cutoff(buckets: np.ndarray, good: np.ndarray, bad: np.ndarray, share: float, level: float) -> int:
    """Reject above the returned bucket; BUCKETS rejects nothing. The three
    arrays are a histogram over score buckets."""
    good_at = np.bincount(buckets, weights=good, minlength=BUCKETS + 1)
    bad_at = np.bincount(buckets, weights=bad, minlength=BUCKETS + 1)
    n_good, n_bad = int(good_at.sum()), int(bad_at.sum())
    allowed = most_rejections(n_good, share, level)
    if allowed < 0 or not n_bad:
        return BUCKETS
    # rejected above c, for c = BUCKETS, BUCKETS - 1, ..., 0
    lost = np.concatenate([[0], np.cumsum(good_at[:0:-1])])
    caught = np.concatenate([[0], np.cumsum(bad_at[:0:-1])])
    certified = lost <= allowed
    value = np.where(certified, caught / n_bad - GOOD_WEIGHT * lost / n_good, -np.inf)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    if best[0] == 0:
        return BUCKETS
    run = best[: np.flatnonzero(np.diff(best, append=-1) != 1)[0] + 1]  # equally good neighbours: the middle
    return BUCKETS - int(run[len(run) // 2])


CUTOFFS = "stratum string, rule string, cutoff int, n_good long, n_bad long"


def fit_cutoffs(features: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang",
                risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per (stratum, rule): a histogram of at most BUCKETS + 1 rows for
    each is all that reaches a task."""
    graded = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
              .groupBy(key).agg(F.max("quality").alias("_good")))
    rows = features.join(graded, key).select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "_good",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(r).alias("bucket")) for r in RULES])).alias("_b"))
    hist = (rows.groupBy("stratum", "_b.rule", "_b.bucket")
            .agg(F.sum(F.when(F.col("_good") > 0, 1).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("_good") > 0, 0).otherwise(1)).alias("bad")))
    hist = stage(hist)
    tests = max(1, hist.select("stratum", "rule").distinct().count())
    share, level = risk / len(RULES), delta / tests

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = pdf["good"].to_numpy(float), pdf["bad"].to_numpy(float)
        cut = choose_cutoff(pdf["bucket"].to_numpy(np.int64), good, bad, share, level)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "rule": [pdf["rule"].iloc[0]], "cutoff": [cut],
                             "n_good": [int(good.sum())], "n_bad": [int(bad.sum())]})

    return hist.groupBy("stratum", "rule").applyInPandas(pick, CUTOFFS)


def stage(hist: DataFrame) -> DataFrame:
    return common.stage(hist, "quality-histogram")


def judge(features: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang",
          risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``features`` (from :func:`add_features`, staged by the caller) with
    base_failed, failed_rules (names) and kept."""
    return apply_cutoffs(features, fit_cutoffs(features, labels, key, stratum, risk, delta), stratum)


def apply_cutoffs(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    cuts = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts"))
    named = features.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    joined = named.join(cuts.withColumnRenamed("stratum", "_stratum"), "_stratum", "left").drop("_stratum")
    failed = F.array_compact(F.array(*[F.when(bucket(r) > F.col("_cuts")[r], F.lit(r)) for r in RULES]))
    return (joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cuts"))


def filter_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang",
                     risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The kept rows of ``docs``, with its columns. The features of labelled
    documents fit the cutoffs; no text is written before the kept rows are."""
    graded = docs.join(labels.select(key).distinct(), key, "left_semi")
    cutoffs = fit_cutoffs(add_features(graded, text, [key, stratum]), labels, key, stratum, risk, delta)
    return apply_cutoffs(add_features(docs, text), cutoffs, stratum).where("kept").select(*docs.columns)
