"""Nearest neighbours, URL rules, secrets and page text."""

import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, html_text, secret_scan, url_filter


@pytest.mark.parametrize("block", [1024, 7])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]                                # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [math.nan] + [1.0] * 7), (304, [None] + [1.0] * 7),
             (305, [math.inf] * 8), (None, [1.0] * 8), (306, [1e200] * 8), (307, [1e-200] * 8), (350, [1.0, 2.0]),
             (351, [2.0, 1.0]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = {}
    for r in ann.nearest_neighbours(docs, F.col("id") % 50 == 0, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in usable if i % 50 == 0}
    for q, found in got.items():
        u = usable[q] / np.abs(usable[q]).max()
        scored = []
        for c, v in usable.items():
            if c != q and len(v) == len(u):
                w = v / np.abs(v).max()
                scored.append((-round(float(u @ w / np.sqrt((u @ u) * (w @ w))), 12), c))
        want = sorted(scored)[:5]
        found = sorted(found)
        assert [(r, -round(s, 12)) for r, _, s in found] == [(n + 1, s) for n, (s, _) in enumerate(want)]
        assert [v for _, v, _ in found] == [c for _, c in want]


def test_quantisation_error_bounds():
    x = np.random.default_rng(2).normal(size=(300, 32))
    codes, scales, errors = ann.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    estimate = (codes[:100].astype(float) @ codes.T.astype(float)) * scales[:100, None] * scales
    bound = errors[:100, None] + (1 + errors[:100, None]) * errors
    assert (np.abs(unit[:100] @ unit.T - estimate) <= bound).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(none, F.col("id") >= 0).count() == 0


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h, p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2] + max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    parts = ["http", "://", "example", ".org", "ORG", ".com", "/es/", "/en/1", "/de/", "/fr/", "?q", "#x", "/", "a", ".",
             "É", "\n", "org", "com", "example.org"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 9)))) for i in range(600)]
    rows += [(1000 + i, "http://" + rng.choice(["a.", "A.B.", ""]) + rng.choice(["example.org", "com", "org", "x.net"])
              + rng.choice(["/es/", "/en/12", "/de/x", "/fr", "/", "", "?/es/"])) for i in range(300)]
    rows += [(None, None), (1, "http://org/"), (1, "http://org/"), (2, ""), (3, "x" * 20000 + "://com/de/" + "y" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = list(url_filter.RULES) + [("block", f"h{i}.net", "/p") for i in range(500)] + [
        ("allow", "example.org", "/es/"), (None, "org", "/"), ("block", None, "/")]
    table = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    got = url_filter.judge(pages, table).collect()
    known = [r for r in rules if None not in r]
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(r.url, known), r.url
    assert {r.verdict for r in url_filter.judge(pages, table.where("false")).collect()} == {"allow"}
    assert url_filter.judge(pages.where("page_id < 0"), table).count() == 0


BRUTE = {"assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    lambda m: len(m[2]) >= 6),
         "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}


def brute_spans(text):
    found = [(m.start(), no, m.end(), kind) for no, (kind, (pattern, fits)) in enumerate(BRUTE.items())
             for m in re.finditer(pattern, text or "") if fits(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(1)
    parts = ["token", "secret", "password", "Passwd", "API_KEY", "apikey", "=", ":", " ", '"', "'", "é", "😀", "AKIA",
             "ABCDEFGH0123", "x", "abc", "0123456789abcdef", "deadbeef", "==", "_", "\n", "/", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(800)]
    rows += [(None, "token=abcdefgh"), (None, None), (5000, None), (5001, ""), (5001, "secret: abcdefgh"),
             (5002, "ghp_" + "a1" * 20 + " " + "prose " * 20000 + "xoxb-0123456789-x"), (5001, "secret: abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    scanned = secret_scan.scan(docs)
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    got = scanned.select("doc_id", "text", secret_scan.joined_spans(base).alias("base"), "spans",
                         secret_scan.redact(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base == brute_spans(r.text), r.text
        clean, at = [], 0
        for s in r.spans:
            if s.start >= at:
                clean.append(r.text[at:s.start] + f"[{s.kind}]")
            at = max(at, s.end)
        assert r.clean == (None if r.text is None else "".join(clean) + r.text[at:])
    kinds = {s.kind for r in got if r.doc_id == 5002 for s in r.spans}
    assert {"github", "slack"} <= kinds
    assert secret_scan.scan(docs.where("doc_id < 0")).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") == []
    assert secret_scan.trigram_query(r"AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
    assert secret_scan.trigram_query(r"ab(cd)?e") == [[frozenset({"abc", "bcd", "cde"}), frozenset({"abe"})]]
    assert secret_scan.trigram_query(r"(abc|.x)yz") == []
    assert secret_scan.trigram_query(r"abc.def") == [[frozenset({"abc"})], [frozenset({"def"})]]
    rng = random.Random(5)
    for rule in secret_scan.RULES:                     # a match satisfies its query
        for text in ("password: abcdefgh", "API_KEY='abcdefg'", "apikey=abcdefgh", "AKIA" + "Z9" * 10, "gho_" + "a" * 40,
                     "xoxp-" + "1" * 12, "AIza" + "b" * 36, "eyJabcdefghi.abcdefghi.abcdefghi",
                     "-----BEGIN RSA PRIVATE KEY-----"):
            text = "".join(rng.choice(" x") for _ in range(3)) + text
            if re.search(rule.pattern, text):
                low = text.lower()
                assert all(any(all(t in low for t in c) for c in run) for run in secret_scan.trigram_query(rule.pattern))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="nav">
<header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div>{template}
<main><h1>Title {n} &eacute;</h1><p>first <i>part</i>
 of&nbsp;{n}<div class="ad">buy</div><p>second &amp; last<br><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>{inner}
<form>send</form><section id="comments"><p>spam</section></main><footer>f</footer>"""


def test_main_text_of_one_page():
    want = "Title 3 é\nfirst part of 3\nsecond & last\nx\ny\n1\n2"
    assert html_text.main_text(PAGE.format(n=3, template="", inner="")) == want
    assert html_text.main_text("") == "" and html_text.main_text("<p>a<p>b &lt;c") == "a\nb <c"
    assert html_text.main_text("plain <b>text") == "plain text"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_ordinary_markup_keeps_the_article():
    text = html_text.main_text
    for body in ('<div class="no-sidebar"><p>body</div>', '<main class="has-sidebar"><p>body</main>',
                 '<article id="comment-policy"><p>body</article>', '<div id="ad-free"><p>body</div>',
                 '<article><p class="notice">body</article>', '<article><p class="related">body</article>',
                 '<div class="sidebar"><main><p>body</main></div>', '<form><article><p>body</article></form>'):
        assert text(f"<html><body>{body}") == "body"
    assert text("<head><title>t</title><body><p>body") == text("<head><title>t</title><p>body") == "body"
    assert text("<head><title>t</title>body") == "body"
    card = "<article><p>teaser</article>"
    assert text(f"<div><p>the main text of a page with a card</div>{card}") == "the main text of a page with a card\nteaser"
    assert text(f"<article><p>the main text</article><div class='sidebar'>{card}</div>") == "the main text"
    gone = ("sidebar", "site-footer", "cookie-notice", "x related", "comments")
    assert all(text(f"<p>own</p><div class='{c}'>no text</div>") == "own" for c in gone)


def test_site_templates_go(spark):
    box, promo = "<div class=b7><p>Welcome to our site</div>", "<div class=q1>More from us</div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><h2>H {i}</h2><p>text {i}</p></div>") for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i}", PAGE.format(n=i, template=box, inner=promo)) for i in range(40)]
    quoted = "<p>a paragraph that many pages quote</p>"
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>own {i}</p>{quoted if i % 2 else ''}</article>") for i in range(40)]
    rows += [(300, "http://lone.example/", f"<body>{box}<p>x"), (301, None, f"<body>{box}"), (302, "http://a.example/x", None),
             (303, "http://a.example/y", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[i] == f"H {i}\ntext {i}" for i in range(40))
    assert all("More from us" not in got[100 + i] and got[100 + i].startswith(f"Title {i}") for i in range(40))
    assert got[201] == "own 1\na paragraph that many pages quote" and got[202] == "own 2"
    assert got[300] == "Welcome to our site\nx" and got[301] == "Welcome to our site" and got[302] == got[303] == ""
    assert html_text.extract(pages.where("page_id < 0")).count() == 0


def test_given_pages(spark, sf_small):
    """The article of the given pages, by regular expressions."""
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    for r in html_text.extract(pages, text="body").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert r.body == "\n".join(b for b in blocks if b)


def test_broken_markup_is_linear_and_never_raises():
    import time
    from larkspur.llm.html_text import main_text
    assert main_text("<p>one</p><![foo[x]]><p>two</p>") == "one\ntwo"
    assert main_text("<![ bar>") == "" and main_text("a < b &amp; c &lt;d") == "a < b & c <d"
    assert main_text("<p>a<!-->b<p>c<script>if (a<b) {}</script>d<textarea>e</textarea>") == "ab\ncd"
    for text in ("<a " * 350_000, "<!-- " * 200_000, "<b>" * 50_000 + "<hr>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000,
                 "</" * 300_000, "<p class='" * 100_000, "<li>" * 100_000, "&amp" * 200_000):
        began = time.process_time()
        main_text(text)
        assert time.process_time() - began < 5, text[:20]
