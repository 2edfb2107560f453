"""The pipeline on a small corpus: every stage against the plain statement of
what it does."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from larkspur.llm import packing, quality, stages
from tests.llm.test_dedup import brute_components, edited, prose, shingles
from tests.llm.test_search import brute_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(25, 120)) for _ in range(60)]
    passage = " ".join("p%d" % rng.randrange(10 ** 6) for _ in range(70))
    texts += [edited(rng, texts[0], i % 3) for i in range(12)] + [texts[1]] * 4
    texts += [passage + "\n" + prose(rng, 60) for _ in range(6)]
    texts += [prose(rng, 40) + ' token = "%040x" ' % rng.getrandbits(160) + prose(rng, 10) for _ in range(5)]
    texts += [prose(rng, 5), "", None, "again and " * 40]
    rows = [(i, t, "en" if i % 7 else None, "hot" if i % 3 else "src", 0) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[2], "en", "src", 1)]
    path = tmp_path_factory.mktemp("corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return str(path)


def staged(spark, folder):
    """What each stage read and returned."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stages.common.stage(stage(spark, docs, folder), name)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stages(spark, folder):
    rules, dedup, cut, secrets, packed = staged(spark, folder)
    for _, after, columns in (rules, dedup, cut, secrets):
        assert columns == COLUMNS
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    before, after, _ = rules
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string")
    base = {(r.doc_id, r.text) for r in quality.add_features(docs).where(~quality.base_failed()).collect()}
    assert {(r.doc_id, r.text) for r in after} == base
    before, after, _ = dedup
    named = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    keep = {i for i, _, _, kept in brute_components(named, stages.NEAR_PERCENT) if kept}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(keep)
    before, after, _ = cut
    assert len(before) == len(after)
    texts = {r.doc_id: r.text for r in before}
    changed = {r.doc_id for r in after if r.text != texts[r.doc_id]}
    holders = sorted(i for i, t in texts.items() if "\n" in (t or ""))
    edits = set(range(60, 72))     # copies that are no near duplicates share passages with their original
    assert set(holders[1:]) <= changed <= set(holders[1:]) | edits
    before, after, _ = secrets
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert brute_spans(r.text) == "" and (r.text == texts[r.doc_id]) == (brute_spans(texts[r.doc_id]) == "")
    before, after, _ = packed
    encode = packing.byte_level_encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert sum(r.length for r in after) == sum(len(encode(r.text or "")) // 4 + 1 for r in before)
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_equals_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    last = staged(spark, folder)[-1][1]
    assert sorted(map(str, got.select("doc_id", "piece", "length").collect())) == sorted(
        str(r) for r in spark.createDataFrame(last, got.schema).select("doc_id", "piece", "length").collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]


def test_empty_corpus(spark, folder, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_links_from_80_percent(spark):
    rng = random.Random(21)
    texts = []
    for n in (60, 105, 140, 200):
        base = [f"b{rng.randrange(10 ** 6)}" for _ in range(n)]
        for edits in range(8):                       # shares on both sides of 0.80 and of 0.85
            words = list(base)
            for at in rng.sample(range(5, n - 5), edits):
                words[at] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    share = {(i, j): len(a & b) / len(a | b) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])}
    group = list(range(len(texts)))
    for (i, j), s in sorted(share.items()):
        if s >= 0.8:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    assert sorted(set(group)) != [i for i, _, _, kept in brute_components(list(enumerate(texts))) if kept]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in stages.near_dedup(spark, docs, "").collect()) == sorted(set(group))


def test_near_dedup_keeps_the_texts_of_one_id(spark):
    rng = random.Random(22)
    one, two, other = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, two), (1, one), (2, other), (3, two)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in stages.near_dedup(spark, docs, "").collect())
    assert got == sorted([(1, one), (1, two), (2, other)])
