"""Exact token counts at every prefix of a text, by dynamic programming.

For a BPE whose merges are ranked, a sequence of tokens is an encoding exactly
if each two neighbours encode, on their own, as just these two. So the
encoding of a prefix ends in the one token that follows validly the encoding
of the shorter prefix before it, and

    count(prefix of j bytes) = count(prefix of j - len(token) bytes) + 1.

One pass over a word gives the counts of all its prefixes (as words, with the
end mark); white space separates words, so the counts at the ends of the words
of a text add up to a table that answers how many tokens any prefix has and
which longest prefix fits a budget, without encoding again.

The vocabulary is a ``tokenizers`` BPE file with a word-end suffix whose
normalisation is NFC, white space, lower case; special strings inside a text
are one token each, as by that library's default.

Defined results: null text is empty, with no tokens; repeated rows are counted
alike; an empty table gives no rows; other columns pass through, those named
like a result are replaced.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import common
from .bpe import WHITE_SPACE
from .packing import byte_alphabet

CACHE_LIMIT = 400_000   # words that one worker keeps; emptied when full
# Separators to Python that are none to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(f"[^{WHITE_SPACE}]+")


class WordTable:
    """Counts of all prefixes of words under one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = {t for t in model["vocab"] if t not in set(self.special)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", WHITE_SPACE))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.library = Tokenizer.from_file(path)
        letters = {b: c for c, b in byte_alphabet().items()}
        self.letters = [letters[b] for b in range(256)]
        self.valid: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, list[int]] = {}
        self.piece_totals: dict[str, int] = {}
        self.totals: dict[str, int] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols; only ever run on two tokens at a time."""
        while len(symbols) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in
                          enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if not token.endswith(self.suffix):
            return list(token)
        stem = token.removesuffix(self.suffix)
        return [*stem[:-1], stem[-1] + self.suffix]

    def follows(self, left: str, right: str) -> bool:
        """Whether the two tokens (the left one may be empty) are the encoding
        of their joint string."""
        if len(self.valid) >= 2 * CACHE_LIMIT:
            self.valid.clear()
        tokens = [left, right] if left else [right]
        got = self.valid[left, right] = self._merged([s for t in tokens for s in self._symbols(t)]) == tokens
        return got

    def _ending(self, word: str, last: list[str], j: int, mark: str) -> int:
        """Length of the token that ends the encoding of the first j letters."""
        vocab, known = self.vocab, self.valid.get
        for i in range(max(0, j - self.longest), j):
            token = word[i:j] + mark
            if token in vocab:
                fits = known((last[i], token))
                if fits or fits is None and self.follows(last[i], token):
                    return j - i
        raise ValueError(f"no token ends at letter {j} of {word!r}")

    def _open_counts(self, word: str) -> tuple[list[int], list[str]]:
        """Tokens, and the last one, of every prefix without the end mark."""
        counts, last = [0], [""]
        for j in range(1, len(word) + 1):
            n = self._ending(word, last, j, "")
            last.append(word[j - n:j])
            counts.append(counts[j - n] + 1)
        return counts, last

    def byte_counts(self, piece: str) -> list[int]:
        """Tokens of every prefix (in bytes) of one piece, each as a whole word."""
        word = "".join([self.letters[b] for b in piece.encode()])
        counts, last = self._open_counts(word)
        return [0] + [counts[j - self._ending(word, last, j, self.suffix)] + 1 for j in range(1, len(word) + 1)]

    def piece_total(self, piece: str) -> int:
        """The last of :meth:`byte_counts`."""
        got = self.piece_totals.get(piece)
        if got is None:
            word = "".join([self.letters[b] for b in piece.encode()])
            if word + self.suffix in self.vocab and self.valid.get(("", word + self.suffix)):
                got = 1
            else:
                counts, last = self._open_counts(word[:-1])
                got = counts[len(word) - self._ending(word, last, len(word), self.suffix)] + 1
            if len(piece) <= 64:
                if len(self.piece_totals) >= CACHE_LIMIT:
                    self.piece_totals.clear()
                self.piece_totals[piece] = got
        return got

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of every prefix (in characters) of one piece. A shortened
        contraction is no contraction: its apostrophe is a piece of its own."""
        by_byte = self.byte_counts(piece)
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(at)
        counts = [0] + [by_byte[e] for e in ends]
        if piece[0] == "'" and len(piece) == 3 and piece[1:] in ("re", "ve", "ll"):
            counts[2] = by_byte[1] + self.chunk_counts(piece[1])[-1]
        return counts

    def normalised(self, text: str) -> str:
        if not text.isascii() and common.unassigned().search(text):
            return self.library.normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # a final sigma has no context here

    def split(self, inner: str) -> list[str]:
        """Pieces of a normalised run without white space."""
        if not inner.isascii() and common.unassigned().search(inner):
            return [inner[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(inner)]
        return self.pieces.findall(inner)

    def chunk_counts(self, chunk: str) -> list[int]:
        """Tokens of every prefix of a normalised run without white space."""
        got = self.tables.get(chunk)
        if got is None:
            got = [0]
            for piece in self.split(chunk):
                before = got[-1]
                got += [before + c for c in self.piece_counts(piece)[1:]]
            if len(chunk) <= 64:
                if len(self.tables) >= CACHE_LIMIT // 4:
                    self.tables.clear()
                self.tables[chunk] = got
        return got

    def total(self, chunk: str) -> int:
        got = self.totals.get(chunk)
        if got is None:
            got = sum(map(self.piece_total, self.split(self.normalised(chunk))))
            if len(chunk) <= 64:
                if len(self.totals) >= 2 * CACHE_LIMIT:
                    self.totals.clear()
                self.totals[chunk] = got
        return got

    def _stretches(self, text: str):
        """(start, stretch, is special) in order."""
        at = 0
        for m in self.specials.finditer(text):
            yield at, text[at:m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        yield at, text[at:], False

    def count(self, text: str) -> int:
        """The last entry of the prefix table."""
        if "<|" not in text and not _ODD.search(text):
            return sum(map(self.total, text.split()))
        return self.prefix_table(text)[1][-1]

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts): tokens of the text up to the end of every word."""
        ends, counts = [0], [0]
        for start, stretch, special in self._stretches(text):
            if special:
                ends.append(start + len(stretch))
                counts.append(counts[-1] + 1)
                continue
            for m in _CHUNK.finditer(stretch):
                ends.append(start + m.end())
                counts.append(counts[-1] + self.total(m[0]))
        return ends, counts

    def count_prefix(self, text: str, table: tuple[list[int], list[int]], n: int) -> int:
        """Tokens of ``text[:n]``, from the table and the prefixes of one word."""
        ends, counts = table
        at = bisect.bisect_right(ends, n) - 1
        part = text[ends[at]:n]
        return counts[at] + sum(map(self.total, _CHUNK.findall(part)))

    def longest_prefix(self, text: str, table: tuple[list[int], list[int]], budget: int) -> int:
        """The longest prefix (code points) of at most ``budget`` tokens; inside
        the word that crosses the budget by that word's own prefix counts."""
        ends, counts = table
        at = bisect.bisect_right(counts, budget) - 1
        if at == len(ends) - 1:
            return len(text)
        word = text[ends[at]:ends[at + 1]]
        found = _CHUNK.search(word)
        chunk, skipped = found[0], found.start()
        if chunk in self.special:
            return ends[at] + skipped
        inner = self.normalised(chunk)
        table_in = self.chunk_counts(inner) if len(inner) == len(chunk) else \
            [self.total(chunk[:j]) if j else 0 for j in range(len(chunk) + 1)]
        best = max(j for j, c in enumerate(table_in) if counts[at] + c <= budget)
        return ends[at] + skipped + best


@lru_cache(maxsize=4)
def word_table(path: str) -> WordTable:
    return WordTable(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens",
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the token count of every whole text."""
    def compute(batch):
        table = word_table(path)
        return [[table.count(t) for t in common.str_texts(common.column(batch, text))]]

    return common.with_columns(docs, T.StructType([T.StructField(out, T.LongType())]), compute, keep)


def prefix_counts(docs: DataFrame, path: str, text: str = "text", budget: int | None = None) -> DataFrame:
    """``docs`` with the prefix table (prefix_ends, prefix_tokens) of every text
    and, with a budget, fit_chars: the longest prefix within it."""
    fields = [T.StructField("prefix_ends", T.ArrayType(T.IntegerType())),
              T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]
    if budget is not None:
        fields.append(T.StructField("fit_chars", T.IntegerType()))

    def compute(batch):
        words = word_table(path)
        texts = common.str_texts(common.column(batch, text))
        tables = [words.prefix_table(t) for t in texts]
        out = [pa.array([t[0] for t in tables], pa.list_(pa.int32())), pa.array([t[1] for t in tables], pa.list_(pa.int32()))]
        if budget is not None:
            out.append([words.longest_prefix(t, table, budget) for t, table in zip(texts, tables, strict=True)])
        return out

    return common.with_columns(docs, T.StructType(fields), compute)
