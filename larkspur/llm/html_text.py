"""Main text of pages by removing the templates of their sites.

Every page is parsed into a tree; each element subtree has a hash of its tags,
classes and text. Spark counts, per host, on how many pages each hash stands.
Subtrees that recur on many pages of their host are deleted, as are elements
whose tag, role or class says that they are no article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments). A class,
id or role says so by a whole token ("sidebar", "site-footer", not
"no-sidebar"), which counts neither for a paragraph or heading inside an
article nor for an element that holds most of the page's article text. What is
left of the article elements, if it is half of all that is left or more, else of
the body, is the text: blocks in page order, one line each.

A subtree outside the article is a template if it is on OUTSIDE_SHARE of its
host's pages, one inside the article only if it is on INSIDE_SHARE of them (a
paragraph that some pages quote is text); both from LEAST_PAGES pages on. So a
host has at most 1 / OUTSIDE_SHARE times as many templates as a page has
subtrees, which bounds the list that meets each page.

Defined results: null or empty html gives the empty text; a page without a
host loses no templates; repeated rows count as pages each; elements that are
not closed end with the page, a tag or comment that is cut off is dropped, any
other broken markup is a comment or text; an empty table gives no rows; the time
for a page is linear in its length, however broken; other columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .url_filter import canonical

LEAST_PAGES = 10
OUTSIDE_SHARE = 0.5
INSIDE_SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul""".split())
ENDS_PARAGRAPH = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
# an element that begins ends these open ones, up to the container
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
            "option": ({"option"}, {"select"})}
NO_TEXT = frozenset("""script style noscript template svg math iframe object canvas head nav footer aside form button
select textarea dialog menu audio video""".split())
NO_TEXT_WORDS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads advert
adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert
popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations
comment comments reply replies discussion disqus respond login search pagination pager toolbar complementary contentinfo
dialog""".split())
NEUTRAL_WORDS = frozenset("""site page main top bottom global primary secondary wrapper wrap container area box block
list bar""".split())
MASTHEAD_WORDS = NO_TEXT_WORDS | {"header", "masthead"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
IN_HEAD = frozenset("title meta link base style script noscript template".split())
ROOTS = ("article", "main")
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "parts", "holds_root")

    def __init__(self, tag: str, words: str = ""):
        self.tag, self.words, self.parts, self.holds_root = tag, words, [], tag in ROOTS


# -- scanning: every character is looked at a bounded number of times, nothing raises

_GAP = re.compile(r"[ \t\n\f\r/]*")
_NAME = re.compile(r"[^ \t\n\f\r/>]+")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\f\r/>=]*")
_EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
_BARE = re.compile(r"[^ \t\n\f\r>]*")
# elements whose content is no markup; in the first two, character references count
_RAW_END = {t: re.compile(f"</{t}(?=[ \\t\\n\\f\\r/>])", re.IGNORECASE)
            for t in ("title", "textarea", "script", "style", "xmp", "iframe", "noembed", "noframes")}


def _tag(html: str, at: int) -> tuple[str, list[tuple[str, str]], bool, int] | None:
    """(name, attributes, closed by a slash, place after it) of the tag whose
    name begins at ``at``; None if it is cut off."""
    found = _NAME.match(html, at)
    name, at, attributes = found[0].lower(), found.end(), []
    while True:
        gap = _GAP.match(html, at)
        at = gap.end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return name, attributes, gap[0].endswith("/"), at + 1
        found = _ATTRIBUTE.match(html, at)
        key, value, at = found[0].lower(), "", found.end()
        equals = _EQUALS.match(html, at)
        if equals:
            at = equals.end()
            quote = html[at:at + 1]
            if quote in ("'", '"'):
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1:end], end + 1
            else:
                found = _BARE.match(html, at)
                value, at = found[0], found.end()
        attributes.append((key, value))


def tokens(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]], bool]]:
    """("text", characters, [], False), ("start", name, attributes, closed by a
    slash) and ("end", name, [], False). Comments, declarations and tags that
    are cut off at the end of the page give nothing."""
    at, n, text = 0, len(html), []

    def run() -> Iterator[tuple]:
        if text:
            yield "text", unescape("".join(text)), [], False
            text.clear()

    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            text.append(html[at:])
            break
        text.append(html[at:open_at])
        follows = html[open_at + 1:open_at + 2]
        end_tag = follows == "/"
        letter = html[open_at + 2:open_at + 3] if end_tag else follows
        if letter.isascii() and letter.isalpha():
            yield from run()
            got = _tag(html, open_at + 1 + end_tag)
            if got is None:
                return
            name, attributes, slash, at = got
            if end_tag:
                yield "end", name, [], False
                continue
            yield "start", name, attributes, slash
            if name in _RAW_END:
                end = _RAW_END[name].search(html, at)
                stop = end.start() if end else n
                inside = html[at:stop]
                yield "text", unescape(inside) if name in ("title", "textarea") else inside, [], False
                at = stop
        elif follows in ("!", "?") or end_tag and letter:
            comment = html.startswith("!--", open_at + 1)
            end = html.find("-->", open_at + 2) if comment else html.find(">", open_at + 2)
            if end < 0:
                break
            at = end + (3 if comment else 1)
        else:
            text.append("<")
            at = open_at + 1
    yield from run()


class TreeBuilder:
    """A tree of nodes; ``parts`` are texts and child nodes in order. ``places``
    knows where each tag is open, so that closing needs no search."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags) -> int:
        return max([p[-1] for t in tags if (p := self.places.get(t))], default=0)

    def _close(self, tags, stop=frozenset()) -> None:
        """Close the innermost open one of ``tags``, unless it lies outside one of ``stop``."""
        at = self._last(tags)
        if at and at > self._last(stop):
            self._cut(at)

    def start(self, tag: str, attributes: list[tuple[str, str]], slash: bool) -> None:
        if tag == "body":       # the end tags of head and body may be left out
            self._close({"head"})
        if tag in ("html", "body"):
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), BLOCK - {"p"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        words = " ".join(unescape(v).lower() for k, v in attributes if v and k in ("class", "id", "role"))
        node = Node(tag, words)
        self.open[-1].parts.append(node)
        if node.holds_root:
            for above in reversed(self.open):
                if above.holds_root:
                    break
                above.holds_root = True
        if tag not in VOID and not slash:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close((tag,))

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    for kind, name, attributes, slash in tokens(html):
        if kind == "text":
            builder.text(name)
        elif kind == "start":
            builder.start(name, attributes, slash)
        else:
            builder.end(name)
    return builder.root


@lru_cache(1 << 14)
def _says(token: str, words: frozenset[str]) -> bool:
    """Whether all of a class, id or role token says that this is no text."""
    parts = set(_WORD.findall(token))
    return not parts.isdisjoint(words) and parts <= words | NEUTRAL_WORDS


def is_boilerplate(node: Node, inside: bool) -> bool:
    if node.tag in NO_TEXT or node.tag == "header" and not inside:
        return True
    if not node.words or inside and node.tag in PROSE:
        return False
    words = NO_TEXT_WORDS if inside else MASTHEAD_WORDS
    return any(_says(token, words) for token in node.words.split())


def root_texts(root: Node) -> dict[int, int]:
    """id(node) -> characters of article text, for nodes that are or hold an
    article or main element."""
    out: dict[int, int] = {}
    sums, stack = [0], [("in", root, False)]
    while stack:
        kind, item, inside = stack.pop()
        if kind == "out":
            out[id(item)] = sums.pop()
            sums[-1] += out[id(item)]
        elif isinstance(item, str):
            sums[-1] += len(item.strip())
        elif (inside or item.holds_root) and item.tag not in ("script", "style"):
            below = inside or item.tag in ROOTS
            if item.holds_root:
                sums.append(0)
                stack.append(("out", item, inside))
            stack += [("in", p, below) for p in item.parts if below or not isinstance(p, str)]
    return out


def walk(root: Node) -> Iterator[tuple[str, object, bool]]:
    """("in", node, inside), ("text", string, inside), ("out", node, inside) in
    page order, without recursion; ``inside`` an article or main element.
    Boilerplate is left out, but not what holds most of the article text."""
    stack: list[tuple[str, object, bool]] = [("in", root, False)]
    held: dict[int, int] | None = None
    while stack:
        kind, item, inside = stack.pop()
        if kind != "in":
            yield kind, item, inside
            continue
        if is_boilerplate(item, inside):
            if not item.holds_root:
                continue
            held = root_texts(root) if held is None else held
            if 2 * held.get(id(item), 0) <= held[id(root)]:
                continue
        below = inside or item.tag in ROOTS
        yield "in", item, inside
        stack.append(("out", item, inside))
        stack += [("text", p, below) if isinstance(p, str) else ("in", p, below) for p in reversed(item.parts)]


def subtree_hashes(root: Node) -> dict[int, tuple[int, bool]]:
    """id(node) -> (hash of its subtree, inside) for block elements with text."""
    out, open_hashes = {}, []
    for kind, item, inside in walk(root):
        if kind == "in":
            open_hashes.append([hashlib.blake2b(f"<{item.tag} {item.words}>".encode("utf-8", "replace"), digest_size=8), False])
        elif kind == "text":
            text = " ".join(item.split())
            if text:
                open_hashes[-1][0].update(b"\x00" + text.encode("utf-8", "replace"))
                open_hashes[-1][1] = True
        else:
            made, texts = open_hashes.pop()
            digest = made.digest()
            if texts and item.tag in BLOCK and item.tag not in ROOTS and item is not root:
                out[id(item)] = (int.from_bytes(digest, "big", signed=True), inside)
            if open_hashes:
                open_hashes[-1][0].update(b"\x01" + digest)
                open_hashes[-1][1] |= texts
    return out


def main_text(html: str, templates: frozenset[tuple[int, bool]] = frozenset()) -> str:
    """The text without the templates ((hash, inside) pairs)."""
    root = parse(html)
    hashes = subtree_hashes(root) if templates else {}
    blocks, current, skipped, was_inside = [], [], 0, False

    def close() -> None:
        text = _SPACES.sub(" ", "".join(current)).strip()
        current.clear()
        if text:
            blocks.append((text, was_inside))

    for kind, item, inside in walk(root):
        if kind == "text":
            if not skipped:
                current.append(item)
                was_inside = inside
            continue
        if item.tag in BLOCK:
            close()
        elif kind == "in" and item.tag in ("br", "img"):
            current.append(" ")
        if hashes.get(id(item)) in templates:
            skipped += 1 if kind == "in" else -1
    close()
    of_roots = [t for t, within in blocks if within]
    most = 2 * sum(map(len, of_roots)) >= sum(len(t) for t, _ in blocks)
    return "\n".join(of_roots if of_roots and most else [t for t, _ in blocks])


def page_subtrees(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, hash, inside): one row per page for each distinct subtree, and one
    with a null hash for the page itself. Needs a column _host."""
    schema = pa.schema([("host", pa.string()), ("hash", pa.int64()), ("inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, common.BATCH_ROWS):
                batch = whole.slice(at, common.BATCH_ROWS)
                rows = []
                for host, page in zip(common.column(batch, "_host").to_pylist(),
                                      common.str_texts(common.column(batch, html)), strict=True):
                    rows.append((host, None, False))
                    rows += [(host, h, i) for h, i in set(subtree_hashes(parse(page)).values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return pages.where("_host != ''").select("_host", html).mapInArrow(run, "host string, hash long, inside boolean")


def site_templates(pages: DataFrame, html: str = "html") -> DataFrame:
    """(_host, _templates): the recurring subtrees of every host that has some."""
    counts = page_subtrees(pages, html).groupBy("host", "hash", "inside").count()
    counts = common.stage(counts, "html-subtrees")
    sizes = counts.where("hash IS NULL").select("host", F.col("count").alias("pages"))
    share = F.when(F.col("inside"), F.lit(INSIDE_SHARE)).otherwise(F.lit(OUTSIDE_SHARE))
    often = counts.where(f"hash IS NOT NULL AND count >= {LEAST_PAGES}").join(sizes, "host").where(
        F.col("count") >= share * F.col("pages"))
    found = often.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("hash", "inside")).alias("_templates"))
    # written, so that the join with the pages has exchanges of its own and a
    # host with very many pages can be split
    return common.stage(found, "html-templates")


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """``pages`` with the main text of the whole html."""
    named = pages.withColumn("_host", canonical(F.col(url))[0])
    joined = named.join(site_templates(named, html), "_host", "left")

    def compute(batch):
        made: dict[str, frozenset] = {}
        out = []
        columns = [common.column(batch, c) for c in ("_host", "_templates", html)]
        for i in range(batch.num_rows):
            host = columns[0][i].as_py()
            if host not in made:
                made[host] = frozenset((t["hash"], t["inside"]) for t in columns[1][i].as_py() or ())
            page = columns[2][i].as_py()
            out.append(main_text(page, made[host]) if page else "")
        return [out]

    return common.with_columns(joined, T.StructType([T.StructField(text, T.StringType())]), compute,
                               keep or pages.columns)
