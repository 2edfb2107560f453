"""Near duplicates and substring dedup against brute force, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, minhash, substring

WORDS = ["w%d" % i for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def shingles(text, width=5):
    out = text or ""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in out).replace("\x0b", " ").replace("\x0c", " ").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, percent=85):
    """{doc_id: (n_shingles, component, kept)} by comparing all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 150))) for i in range(40)]
    rows += [(100 + i, edited(rng, base, i % 8)) for i in range(60)]          # near copies, some too far
    rows += [(200 + i, rows[3][1].upper()) for i in range(5)]                 # equal sets
    passage = prose(rng, 60)
    rows += [(300 + i, passage + " " + prose(rng, 30)) for i in range(30)]    # a frequent passage, no copies
    rows += [(400, ""), (401, None), (402, " \t\n"), (403, "one two"), (404, "ONE two"), (405, "one"),
             (None, base), (None, None), (100, edited(rng, base, 1)), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_equal_brute_force(spark, corpus, block):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = minhash.near_duplicates(docs, block=block).collect()
    named = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None)
    assert named == sorted(brute_components(corpus))
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert len(got) == len(corpus)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7), (5, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys([*range(100, 140), 200], 100)}


def test_required_overlap_bounds_the_miss():
    t = minhash._least_shared(64, 85)
    rng = np.random.default_rng(0)
    assert (rng.binomial(64, 0.85, 200_000) >= t).all() and t > 25


def test_cut_points_resist_insertions():
    rng = random.Random(1)
    passage = [rng.choice(WORDS) + str(rng.random()) for _ in range(200)]
    lists = []
    for n in (0, 1, 7, 33):
        text = " ".join([str(rng.random()) for _ in range(n)] + passage).encode()
        lists.append(set(substring.chunks(text)[0].tolist()))
    assert all(len(lists[0] & other) > 0.85 * len(lists[0]) for other in lists[1:])


def test_chunks_cover_the_words():
    text = ("  é😀 b\tc\n" * 50).encode()
    digest, words, begin, stop = substring.chunks(text)
    assert words.sum() == 150 and (words <= substring.MOST).all()
    assert [text[b:s].split() for b, s in zip(begin, stop)] == [
        text.split()[a:a + w] for a, w in zip(np.cumsum(words) - words, words)]
    assert len(substring.chunks(b" \n ")[0]) == 0


def test_repeated_passages_are_cut(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join("%s%d" % (rng.choice(WORDS), rng.randrange(10 ** 6)) for _ in range(n))
    passages = [fresh(60) for _ in range(30)]
    rows, holders = [], {}
    for i in range(90):
        p = rng.randrange(30)
        rows.append((i, fresh(20) + "\n" + passages[p] + " " + fresh(15)))
        holders.setdefault(p, []).append(i)
    inner = fresh(40)
    rows += [(500, inner + " " + inner), (501, ""), (502, None), (None, passages[0]), (503, passages[0]),
             (504, fresh(8) + " " + passages[1][:60]), (600, fresh(30)), (600, rows[0][1]), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunks", F.lit(1))
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "chunks", "passages"}
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    caught = later = 0
    for p, ids in holders.items():
        assert not by_id[ids[0]][0].passages                          # the first document keeps it
        assert by_id[ids[0]][0].text == rows[ids[0]][1]
        for i in ids[1:]:
            later += 1
            cut = by_id[i][0]
            caught += bool(cut.passages) and passages[p] not in cut.text
            words = set(cut.text.split())
            assert set(rows[i][1].split()[:12]) <= words               # text of its own stays
    assert caught >= 0.98 * later
    assert by_id[500][0].text == rows[90][1] and by_id[502][0].text is None and by_id[501][0].text == ""
    assert by_id[None][0].text == passages[0] and not by_id[504][0].passages
    assert by_id[7][0].text == by_id[7][1].text                       # repeated rows are one document
    assert len(by_id[503][0].text.split()) < 25
    assert substring.remove_repeats(docs.where("doc_id < 0")).count() == 0


def test_only_runs_that_one_earlier_document_holds_are_cut(spark):
    rng = random.Random(31)
    fresh = lambda n: ["u%d" % rng.randrange(10 ** 9) for _ in range(n)]
    phrases = [fresh(14) for _ in range(12)]                              # each stands in a document of its own
    rows = [(i, " ".join(fresh(15) + p + fresh(15))) for i, p in enumerate(phrases)]
    mosaic = " ".join(w for p in phrases for w in p)
    rows += [(100, mosaic), (101, " ".join(fresh(9)) + " " + mosaic)]     # a passage made of them, and its copy
    rows += [(200, " ".join(["the"] * 12)), (201, "the " * 40 + "end"), (202, " ".join(fresh(30)))]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert [i for i in sorted(got) if got[i].passages] == [101]
    assert all(got[i].text == texts[i] for i in texts if i != 101)
    assert got[101].passages[0].first_docs == [100] and sum(p.words for p in got[101].passages) > 168 - 2 * substring.MOST
    for p in got[101].passages:
        assert texts[101].encode()[p.begin:p.stop].decode() in texts[100]


def brute_passages(rows, width):
    """{doc_id: [(begin, stop, words, first_docs)]} by comparing tuples of words."""
    held, cuts = {}, {}
    for i, t in rows:
        words = (t or "").encode().split()
        digest, sizes, *_ = substring.chunks((t or "").encode())
        ends = np.cumsum(sizes).tolist()
        starts = [0, *ends[:-1]]
        places = []
        for a, s in enumerate(starts):
            if s + width <= len(words):
                b = next(b for b in range(a, len(ends)) if ends[b] >= s + width)
                places.append((a, b))
        if places:
            places.append((places[-1][0], len(ends) - 1))
        cuts[i] = [(tuple(tuple(words[starts[k]:ends[k]]) for k in range(a, b + 1)), starts[a], ends[b]) for a, b in places]
        for chain, *_ in cuts[i]:
            held[chain] = min(held.get(chain, i), i)
    out = {}
    for i, _ in rows:
        found = []
        for chain, s, e in cuts[i]:
            if held[chain] < i:
                if found and s <= found[-1][1]:
                    found[-1] = (found[-1][0], max(e, found[-1][1]), found[-1][2] | {held[chain]})
                else:
                    found.append((s, e, {held[chain]}))
        out[i] = [(s, e - s, sorted(d)) for s, e, d in found]
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(400)]
    pool = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 90))) for _ in range(12)]
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 4)) for x in (
        " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(pool)))) for i in range(120)]
    rows += [(200, rows[5][1]), (201, "x " * 5000), (202, "x " * 4000), (203, "\n".join(pool))]
    want = brute_passages(rows, substring.CHAIN)
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in got:
        begins = [len(texts[r.doc_id].encode()[:p.begin].split()) for p in r.passages]
        assert [(b, p.words, list(p.first_docs)) for b, p in zip(begins, r.passages)] == want[r.doc_id], r.doc_id
    assert sum(map(len, want.values())) > 50
