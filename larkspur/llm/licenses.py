"""License wording found by template automata over words.

A template is wording with markup: ``[[...]]`` may be missing (and may nest),
``{{n}}`` stands for up to n words of any kind (a holder, a year). It compiles
into a position automaton (Glushkov): one state per word or wildcard place,
with the places that may follow it. A text holds the license if some stretch of
its words runs through the automaton, that is, if all mandatory wording stands
there word for word, with nothing between but what the markup allows.

The longest run of mandatory words is a template's anchor. Anchors are sought
in the text as it stands in lower case; from each place the automaton of the
wording after the anchor runs forwards and that of the wording before it, turned
round, runs backwards, both to the farthest accepting word.

A word is a run of letters, digits and characters beyond ASCII; A-Z count as
a-z, nothing else is folded.

Defined results: null text is empty, with no words, no labels and score 0;
places of different templates may overlap, ties and repeats are all listed, by
start, end and template; repeated rows are scanned alike; an empty table gives
no rows; other columns pass through when named in ``keep``, one named like a
result is replaced. Work on a very long text is linear in its words and in its
anchors, of which each costs at most one walk through a template.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

# Base phrases and their labels.
BASE_PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
    "permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software")
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement")
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution")
_GPL_HEADER = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version {v} of the license or at your option any later version")

# Wording of public licenses and of the notices that name them.
TEMPLATES = (
    ("mit", "[[the mit license [[mit]]]] [[copyright [[c]] {{20}}]] " + _MIT_GRANT + " [[" + _AS_IS + "]]"),
    ("isc", "[[isc license]] [[copyright [[c]] {{20}}]] permission to use copy modify and or distribute this software for any "
            "purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
            "notice appear in all copies"),
    ("bsd-2-clause", _BSD_START + " this software is provided by {{12}} as is"),
    ("bsd-3-clause", _BSD_START + " [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse "
                                  "or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
             "liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance "
                   "with the license [[you may obtain a copy of the license at {{8}}]]]]"),
    ("apache-2.0", "[[spdx license identifier]] apache 2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl-2.0-or-later", _GPL_HEADER.replace("{v}", "2")),
    ("gpl-3.0-or-later", _GPL_HEADER.replace("{v}", "3")),
    ("gpl-2.0", "gnu general public license [[gpl]] [[as published by the free software foundation]] version 2"),
    ("gpl-3.0", "gnu general public license [[gpl]] [[as published by the free software foundation]] version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-4.0", "cc by [[license]] 4 0"),
    ("cc-by-sa-4.0", "cc by sa [[license]] 4 0"),
    ("cc-by-nc-4.0", "cc by nc [[license]] 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa [[license]] 4 0"),
    ("cc-by-nd-4.0", "cc by nd [[license]] 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international [[public]] [[license]]"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international [[public]] [[license]]"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international [[public]] [[license]]"),
    ("cc0-1.0", "cc0 1 0 [[universal]]"),
    ("all-rights-reserved", "[[copyright [[c]] {{12}}]] all rights reserved"),
)


# -- templates ---------------------------------------------------------------

class Node(NamedTuple):
    """A word, a wildcard place (word None), or an optional part."""
    word: bytes | None
    part: tuple = ()
    optional: bool = False


_TOKEN = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")


def parse(template: str) -> list[Node]:
    """The parts of a template in order."""
    stack: list[list[Node]] = [[]]
    for token in _TOKEN.findall(template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            part = tuple(stack.pop())
            if not stack:
                raise ValueError(f"]] without [[ in {template!r}")
            stack[-1].append(Node(None, part, True))
        elif token.startswith("{{"):
            wild = [Node(None)] * int(token[2:-2])
            stack[-1] += [Node(None, (w,), True) for w in wild]
        else:
            stack[-1].append(Node(token.encode()))
    if len(stack) != 1:
        raise ValueError(f"[[ without ]] in {template!r}")
    return stack[0]


class Automaton:
    """Position automaton of a list of parts; ``accept(words, at, step)`` gives
    how many words from ``at`` on, in the direction of ``step``, the longest
    accepted stretch has, or None."""

    def __init__(self, parts: list[Node]):
        self.words: list[bytes | None] = []
        self.follow: list[set[int]] = []
        self.first, self.last, self.empty = self._build(parts)

    def _build(self, parts: list[Node]) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for node in parts:
            if node.part:
                f, e, can_skip = self._build(list(node.part))
            else:
                p = len(self.words)
                self.words.append(node.word)
                self.follow.append(set())
                f, e, can_skip = {p}, {p}, False
            can_skip = can_skip or node.optional
            for p in last:
                self.follow[p] |= f
            first |= f if empty else set()
            last = last | e if can_skip else e
            empty = empty and can_skip
        return first, last, empty

    def accept(self, words: list[bytes], at: int, step: int) -> int | None:
        best = 0 if self.empty else None
        places, n = self.first, 0
        while places and 0 <= at < len(words):
            word = words[at]
            live = {p for p in places if self.words[p] is None or self.words[p] == word}
            if not live:
                break
            n += 1
            at += step
            if live & self.last:
                best = n
            places = set().union(*[self.follow[p] for p in live])
        return best


def _turned(parts: list[Node]) -> list[Node]:
    return [n._replace(part=tuple(_turned(list(n.part)))) if n.part else n for n in reversed(parts)]


class Template:
    """A compiled template: its anchor and the automata on both sides of it."""

    def __init__(self, label: str, text: str):
        parts = parse(text)
        runs, start = [], None
        for i, node in enumerate([*parts, Node(None)]):
            if node.word is not None and start is None:
                start = i
            elif node.word is None and start is not None:
                runs.append((i - start, -start))
                start = None
        if not runs:
            raise ValueError(f"template of {label} has no mandatory words")
        size, start = max(runs)
        start = -start
        self.label, self.size = label, size
        self.anchor = b" " + b" ".join(n.word for n in parts[start:start + size]) + b" "
        self.before, self.after = Automaton(_turned(parts[:start])), Automaton(parts[start + size:])

    def places(self, joined: bytes, words: list[bytes], starts: list[int]) -> list[tuple[int, int]]:
        """(first word, word after the last) of every stretch around an anchor.
        Anchors may overlap; each is tried."""
        out, at = [], joined.find(self.anchor)
        while at >= 0:
            first = bisect_right(starts, at + 1) - 1
            after = self.after.accept(words, first + self.size, 1)
            before = self.before.accept(words, first - 1, -1) if after is not None else None
            if before is not None:
                out.append((first - before, first + self.size + after))
            at = joined.find(self.anchor, at + 1)
        return out


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[Template]:
    return [Template(label, text) for label, text in templates]


# -- texts -------------------------------------------------------------------

# ASCII that is no word character becomes a space, A-Z become a-z.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else ord(" ") for c in range(256))


class Found(NamedTuple):
    n_words: int
    base: list[tuple[int, int, int]]      # (start, end, number of the phrase)
    own: list[tuple[int, int, int]]       # (start, end, number of the template)


def find(raw: bytes, base: list[Template], own: list[Template]) -> Found:
    words = raw.translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    hit = {t for t in (*base, *own) if t.anchor in joined}
    if not hit:
        return Found(len(words), [], [])
    starts = list(accumulate((len(w) + 1 for w in words), initial=1))
    found = [sorted((a, b, i) for i, t in enumerate(group) if t in hit for a, b in t.places(joined, words, starts))
             for group in (base, own)]
    return Found(len(words), *found)


def covered(spans: list[tuple[int, int, int]]) -> int:
    """Words that stand in some span."""
    total, reach = 0, 0
    for a, b, _ in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


RESULTS = common.schema(
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
).add("spans", T.ArrayType(common.schema("start long, end long, label string")))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
         phrases: tuple[tuple[str, str], ...] = BASE_PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` with n_words; n_base, first_word, last_word and base_labels of
    the phrases' places; labels of phrases and templates; score, the share of
    the text's words that stand in a place of either; spans, the places of both
    (words, end exclusive)."""
    phrases, templates = tuple(phrases), tuple(templates)

    def compute(batch: pa.RecordBatch) -> list[list]:
        base, own = compiled(phrases), compiled(templates)
        rows = []
        for raw in common.byte_texts(common.column(batch, text)):
            found = find(raw, base, own)
            starts = [a for a, _, _ in found.base]
            base_labels = {base[i].label for _, _, i in found.base}
            labels = base_labels | {own[i].label for _, _, i in found.own}
            spans = sorted([(a, b, base[i].label) for a, b, i in found.base] + [(a, b, own[i].label) for a, b, i in found.own])
            score = covered(found.base + found.own) / found.n_words if found.n_words else 0.0
            rows.append((found.n_words, len(found.base), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
                         [{"start": a, "end": b, "label": name} for a, b, name in spans]))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in RESULTS.fields]

    return common.with_columns(docs, RESULTS, compute, keep)
