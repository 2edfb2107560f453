"""Quality features, bounds and cutoffs."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import quality
from larkspur.llm.shingles import WordHashes


def brute_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def test_features_equal_brute_force(spark):
    rng = random.Random(0)
    parts = ["a", "bé", "😀x", "#", "|", "\n", " ", "\t", "a b c d e f g h", "A!", "\x0b", " ", "\r\n"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "a " * 30), (903, "x" * 5000), (904, "\n\n"), (902, "a " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = quality.add_features(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_features(r.text), r.text


def test_repeated_words_short_texts():
    words = WordHashes()
    assert quality.repeated_words(words.of([])) == quality.repeated_words(words.of([b"a"] * 8)) == 0
    assert quality.repeated_words(words.of([b"a"] * 9)) == 9


def test_binomial_bound_is_exact():
    for n, p in ((1, 0.3), (40, 0.01), (700, 0.02), (900, 0.5)):
        for x in {0, 1, n // 50, n // 2, n - 1}:
            exact = math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(x + 1))
            assert math.isclose(quality.binomial_cdf(x, n, p), exact, rel_tol=1e-9, abs_tol=1e-300)
    assert quality.most_rejections(10, 0.01, 0.05) == -1 == quality.most_rejections(0, 0.1, 0.1)
    most = quality.most_rejections(5000, 0.01, 0.005)
    assert quality.binomial_cdf(most, 5000, 0.01) <= 0.005 < quality.binomial_cdf(most + 1, 5000, 0.01)


def test_cutoff_limits_false_rejections():
    rng = np.random.default_rng(1)
    good, bad = rng.binomial(1000, 0.02, 4000), rng.binomial(1000, 0.4, 500)
    b = np.concatenate([good, bad])
    is_good = np.concatenate([np.ones(4000), np.zeros(500)])
    cut = quality.choose_cutoff(b, is_good, 1 - is_good, 0.01, 0.005)
    assert good.max() <= cut < bad.min()
    mixed = rng.permutation(b)                                   # a score that tells nothing
    cut = quality.choose_cutoff(mixed, is_good, 1 - is_good, 0.01, 0.005)
    assert (mixed[is_good == 1] > cut).mean() <= 0.01
    assert quality.choose_cutoff(b[:300], is_good[:300], 1 - is_good[:300], 0.01, 0.005) == quality.BUCKETS


def test_judge(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1600):
        words = ["w%d" % rng.randrange(5000) for _ in range(40)]
        junk = i % 8 == 0
        rows.append((i, " ".join(w + "%%%" if junk else w for w in words), "en" if i % 200 else None))
        if i < 1400:
            labels.append((i, int(not junk), 0))
    rows += [(5000, None, "en"), (5001, "too short", "xx"), (5002, " ".join("w%d %%%%%%" % j for j in range(60)), "zz"),
             (None, " ".join("w%d" % j for j in range(60)), "en")]
    labels += [(8, 1, 0), (None, 0, 0), (9, None, 0), (77777, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    features = quality.add_features(docs, keep=["doc_id", "lang"]).cache()
    got = {r.doc_id: r for r in quality.judge(features, table).collect()}
    assert all(not got[i].kept and got[i].failed_rules == ["symbols"] for i in range(1600) if i % 8 == 0 and i % 200)
    assert all(got[i].kept for i in range(1600) if i % 8)
    assert got[0].kept                              # a stratum with few labels rejects nothing
    assert got[5000].base_failed and got[5001].base_failed and got[5002].kept and got[None].kept
    none = quality.judge(features, table.where("doc_id < 0")).collect()
    assert all(r.kept != r.base_failed for r in none)
    kept = quality.filter_documents(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert quality.judge(features.where("doc_id < 0"), table).count() == 0
