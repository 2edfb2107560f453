"""License wording against matches of plain regular expressions."""

import random
import re

from larkspur.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICES = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "cc by cc by", "MIT-License", "mit\nlicense",
    "the gnu   general\tpublic (license)", "CC BY-SA 4.0", "Apache-2.0", "All rights reserved."]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expression(template):
    """The template as a regular expression over ' word' strings."""
    out = []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out.append("(?:" if token == "[[" else ")?" if token == "]]" else
                   "(?: \\S+){0,%s}" % token[2:-2] if token.startswith("{{") else re.escape(" " + token))
    return re.compile("".join(out) + r"(?= |$)")


def brute(text):
    w = words(text)
    joined = "".join(" " + x for x in w)
    base = sorted((i, label) for label, phrase in licenses.BASE_PHRASES for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split())
    labels = {b for _, b in base} | {label for label, t in licenses.TEMPLATES if expression(t).search(joined)}
    return (len(w), len(base), min([i for i, _ in base], default=None), max([i for i, _ in base], default=None),
            ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)))


def full_texts():
    out = []
    for _, t in licenses.TEMPLATES:
        kept = re.sub(r"\[\[|\]\]", "", t)
        dropped = t
        while "[[" in dropped:
            dropped = re.sub(r"\[\[[^\[\]]*\]\]", "", dropped)
        for text in (kept, dropped):
            out.append(re.sub(r"\{\{\d+\}\}", "2024 Jane Doe", text).title())
            out.append(re.sub(r"\{\{\d+\}\}", "", text))
    return out


def odd_texts():
    rng = random.Random(5)
    bits = [*NOTICES, *full_texts(), "Lorem ipsum", "ÄÖ license", "cc", "by", "gnu", "license", "mit", "2 0", "\n", "你好", "x" * 300]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 5))) for _ in range(150)]
    for t in full_texts():              # one mandatory word changed or dropped
        w = t.split()
        i = rng.randrange(len(w))
        texts += [" ".join(w[:i] + ["other"] + w[i + 1:]), " ".join(w[:i] + w[i + 1:]), t]
    return texts + ["", " ", None, "-", "mit license " * 3000]


def test_against_regular_expressions(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "MIT license", "clash")] * 2,
                                 "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        assert got == brute(r.text), r.text
        w = words(r.text)
        marked = {i for s in r.spans for i in range(s.start, s.end)}
        assert r.score == (len(marked) / len(w) if w else 0.0)
        assert all(0 <= s.start < s.end <= len(w) for s in r.spans)
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "x must a b c hold y"), (2, "must hold"), (3, "must a b c d hold"), (4, "must not")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, phrases=(), templates=(("t", "[[x]] must {{3}} hold [[y [[z]]]]"),)).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(0, 7)]
    assert got[2].labels == "t" and got[3].labels == "" and got[4].labels == ""


def test_query_on_a_folder(spark, tmp_path):
    texts = odd_texts()[:60] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_license_scan(spark, str(tmp_path)).collect()
    assert list(rows[0].asDict()) == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(texts[r.doc_id])
