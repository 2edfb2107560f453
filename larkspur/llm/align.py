"""Alignment of two tokenizations of the same text, with corpus-wide counts of
the token id pairs that they link.

Tokenizer A is a ``tokenizers`` byte-level BPE file (``space + text``, special
strings as plain text), B a ``sentencepiece`` BPE model, which adds the space
itself. Both give the bytes of ``space + text`` again, so tokens have byte
ranges.

1. A text is tokenised in full by both. (A single space between two characters
   that are no white space starts a token in both, so what stands between two
   such spaces is looked up once it was encoded.)
2. Anchors are byte offsets where a token of A and one of B end and the next
   tokens of both are marked with a space. They are verified on the offsets,
   not assumed from the text. Between anchors lie windows: a tuple of A ids and
   a tuple of B ids.
3. The alignment of a window depends on its id tuples alone and is kept under
   them: its groups (cut at shared ends) and its links (overlapping tokens). A
   chunk that turns out to be one window remembers which.
4. A document's distinct linked pairs are counted over the corpus. Documents
   are gathered into blocks until these have BLOCK_LINKS links (or one long
   document has more); a block lists each pair once with the number of its
   documents that hold it, so that a pair meets its corpus count once a block,
   not once a document.

Defined results: null or empty text, and text whose tokens of A or B do not
give the bytes of ``space + text`` (one with U+2581), has no tokens, all
figures 0 and groups ''. A repeated row is a document of its own. Ties for an
A id's highest count all are best. An empty table gives no rows. Other columns
pass through when named in ``keep``; one named like a result is replaced. A very
long text is tokenised whole in one task, its windows are small.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import ByteTable
from .packing import byte_alphabet

BLOCK_LINKS = 2_000_000
CACHE_LIMIT = 200_000   # chunks, and windows, that one worker keeps; emptied when full
LONGEST_KEPT = 64       # code points of a chunk, ids of a window that are kept
TOGETHER = 2_000        # chunks that are encoded as one text
_SPACE = "▁"
# Where both tokenizers start a token. Python's \s holds every white space of A's pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\s\s")


class TokenizerA:
    """Ids and entry bytes of a byte-level BPE file whose ids are merge ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: t for t, i in ranks.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.bpe.encode_ordinary(" " + t) for t in texts]


class TokenizerB:
    """Ids and piece bytes of a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        inner = False
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            else:
                self.bytes[i] = piece.replace(_SPACE, " ").encode()
                inner = inner or _SPACE in piece.lstrip(_SPACE)
        self.cuts_at_spaces = not inner   # no piece goes on past a space

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Windows:
    """Alignments of windows by their id tuples: for each window its groups as
    text, their number, and its links as numbers of id pairs. Windows that are
    new in a step are aligned together."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.size_a, self.space_a = _tables(a)
        self.size_b, self.space_b = _tables(b)
        self.of_b = 3 * len(self.size_a)
        # decimal ids behind what separates them: none, the last group's end, the last id's end; in B, A's end
        written = {n * len(self.size_a) + i: b"%s%d" % (sep, i) for n, sep in enumerate((b"", b";", b",")) for i in a}
        written |= {self.of_b + n * len(self.size_b) + i: b"%s%d" % (sep, i) for n, sep in enumerate((b"|", b",")) for i in b}
        self.written = ByteTable(written)
        self.bound_pairs(0)

    def bound_pairs(self, limit: int | None = None) -> None:
        """Between two blocks, which refer to pairs by their numbers."""
        if limit is None and len(self.pairs) <= 3 * CACHE_LIMIT:
            return
        self.pair_no: dict[int, int] = {}
        self.pairs: list[int] = []          # pair number -> a << 32 | b
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.groups: list[bytes] = []
        self.n_groups = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int32)  # pair numbers, window after window
        self.ends = np.zeros(0, np.int64)   # where the links of each window end
        self.kept, self.cleared = 0, True

    def trim(self) -> bool:
        """Before a step: drop the long windows of the step before, or all if
        they are too many. Whether numbers from before are void."""
        if self.kept > CACHE_LIMIT:
            self.clear()
        elif self.kept < len(self.groups):
            del self.groups[self.kept:]
            self.n_groups, self.ends = self.n_groups[:self.kept], self.ends[:self.kept]
            self.links = self.links[:self.ends[-1] if self.kept else 0]
        void, self.cleared = self.cleared, False
        return void

    def numbers(self, keys: list[tuple[bytes, bytes]]) -> np.ndarray:
        """The number of each window; those from ``kept`` on hold for this step."""
        known = self.known
        got = list(map(known.get, keys))
        missing = [i for i, n in enumerate(got) if n is None]
        if missing:
            new, most = dict.fromkeys([keys[i] for i in missing]), 4 * LONGEST_KEPT
            short = [k for k in new if len(k[0]) <= most and len(k[1]) <= most]
            first = len(self.groups)
            known.update(zip(short, range(first, first + len(short)), strict=True))
            self.kept += len(short)
            if len(short) < len(new):       # long ones last
                short += new.keys() - known.keys()
            self._add(short)
            added = dict(zip(short, range(first, first + len(short)), strict=True))
            for i in missing:
                got[i] = added[keys[i]]
        return np.array(got, np.int64)

    def _add(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Align the windows: tokens overlap between any two neighbouring ends."""
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), "<u4").astype(np.int64) for side in (0, 1))
        stop_a, stop_b = (np.cumsum([len(k[side]) // 4 for k in keys]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        distinct, place = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        numbers = []
        for pair in distinct.tolist():
            number = self.pair_no.get(pair)
            if number is None:
                number = self.pair_no[pair] = len(self.pairs)
                self.pairs.append(pair)
            numbers.append(number)
        offsets = ends_a[stop_a - 1]                       # where the windows end
        before = len(self.links)
        self.links = np.concatenate([self.links, np.array(numbers, np.int32)[place]])
        self.ends = np.concatenate([self.ends, before + np.searchsorted(ends, offsets, "right")])
        # groups: cut at the shared ends; in each the ids of A, then those of B
        shared = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]
        self.n_groups = np.concatenate([self.n_groups, np.diff(np.searchsorted(shared, offsets, "right"), prepend=0)])
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        first_a = np.diff(group_a, prepend=-1) > 0
        separator = np.where(first_a, 1, 2)
        separator[np.concatenate([[0], stop_a[:-1]])] = 0
        text = np.empty(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = separator * len(self.size_a) + a
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = (
            self.of_b + np.where(np.diff(group_b, prepend=-1) > 0, 0, 1) * len(self.size_b) + b)
        raw, written = self.written.placed(text)
        cuts = [0, *written[stop_a + stop_b - 1].tolist()]
        self.groups += [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair numbers of the windows' links, where each window's end)."""
        ends = self.ends[numbers]
        sizes = ends - np.where(numbers > 0, self.ends[numbers - 1], 0)
        upto = np.cumsum(sizes)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(ends - upto, sizes)
        return self.links[at], upto


class Tokens(NamedTuple):
    """The ids of some documents, end to end; chunk numbers with their ids'
    counts; where the ids of each document end."""
    a: np.ndarray
    b: np.ndarray
    chunks: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


class Ragged:
    """Rows of numbers, end to end."""

    def __init__(self):
        self.values, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def append(self, values: list[np.ndarray], sizes: np.ndarray) -> None:
        before = len(self.values)
        self.values = np.concatenate([self.values, *values])
        self.ends = np.concatenate([self.ends, before + np.cumsum(sizes, dtype=np.int64)])

    def cut(self, rows: int) -> None:
        self.ends = self.ends[:rows]
        self.values = self.values[:self.ends[-1] if rows else 0]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows, their sizes)"""
        ends = self.ends[rows]
        sizes = ends - np.where(rows > 0, self.ends[rows - 1], 0)
        upto = np.cumsum(sizes)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(ends - upto, sizes)
        return self.values[at], sizes


class Aligner:
    """Both tokenizers, the chunks that were encoded, and the windows of one
    worker. A chunk that is one window knows the window's number."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = TokenizerA(path_a), TokenizerB(path_b)
        self.windows = Windows(self.a.bytes, self.b.bytes)
        self.entry_a, self.entry_b = ByteTable(self.a.bytes), ByteTable(self.b.bytes)
        self.forget()

    def forget(self) -> None:
        self.chunk_no: dict[str, int] = {}
        self.ids_a, self.ids_b = Ragged(), Ragged()
        self.odd = np.zeros(0, bool)               # chunks whose tokens do not give their bytes
        self.window_of = np.zeros(0, np.int64)     # window number, or -1

    def _trim(self) -> None:
        n = len(self.chunk_no)
        if n > CACHE_LIMIT:
            self.forget()
        else:                                      # the long chunks of the step before
            self.ids_a.cut(n)
            self.ids_b.cut(n)
            self.odd, self.window_of = self.odd[:n], self.window_of[:n]
        if self.windows.trim():
            self.window_of[:] = -1

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        """Encode chunks, many in one text: a cut between two of them is one in
        the tokens as well, which their ends confirm. Long ones come last and
        hold for this step. Returns the numbers of all."""
        joint = [c for c in chunks if len(c) <= LONGEST_KEPT and c.strip() == c] if self.b.cuts_at_spaces else []
        others = set(chunks).difference(joint) if len(joint) < len(chunks) else ()
        alone = sorted(others, key=lambda c: len(c) > LONGEST_KEPT)
        for part in [joint[i:i + TOGETHER] for i in range(0, len(joint), TOGETHER)] + [[c] for c in alone]:
            if not self._encode(part):
                for c in part:
                    self._encode([c], forced=True)
        first = len(self.chunk_no)
        numbers = dict(zip(joint + alone, range(first, first + len(chunks)), strict=True))
        self.chunk_no.update(numbers)
        for c in alone:
            if len(c) > LONGEST_KEPT:
                del self.chunk_no[c]
        return numbers

    def _encode(self, part: list[str], forced: bool = False) -> bool:
        text = " ".join(part)
        raw = (" " + text).encode()
        ends = np.cumsum([len(c) for c in map(str.encode, part)]) + np.arange(1, len(part) + 1)
        made, same = [], True
        for tokenizer, entry in ((self.a, self.entry_a), (self.b, self.entry_b)):
            ids = np.array(tokenizer.encode([text])[0], np.uint32)
            written, stops = entry.placed(ids)
            at = np.searchsorted(stops, ends)
            if written != raw or at[-1] >= len(stops) or (stops[at] != ends).any():
                if not forced:
                    return False
                same, at = same and written == raw, np.array([len(ids) - 1])
            made.append((ids, np.diff(at + 1, prepend=0)))
        for store, (ids, sizes) in zip((self.ids_a, self.ids_b), made, strict=True):
            store.append([ids], sizes)
        self.odd = np.append(self.odd, np.full(len(part), not same))
        self.window_of = np.append(self.window_of, np.full(len(part), -1))
        return True

    def split(self, text: str) -> list[str]:
        if not self.b.cuts_at_spaces:
            return [text]
        if _UNEVEN.search(text) or text[0] == " " or text[-1] == " ":
            return _CUT.split(text)
        return text.split(" ")

    def tokenise(self, texts: list[str]) -> Tokens:
        """The whole texts' tokens; a text whose tokens do not give its bytes has none."""
        self._trim()
        split = [self.split(t) if t else [] for t in texts]
        chunks = list(chain.from_iterable(split))
        got = list(map(self.chunk_no.get, chunks))
        missing = [i for i, n in enumerate(got) if n is None]
        if missing:
            numbers = self._learn(list({chunks[i] for i in missing}))
            for i in missing:
                got[i] = numbers[chunks[i]]
        numbers, ends = np.array(got, np.int64), np.cumsum([len(c) for c in split])
        odd = self.odd[numbers]
        if odd.any():
            keep = np.ones(len(numbers), bool)
            for doc in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")).tolist():
                start, stop = ends[doc] - len(split[doc]), ends[doc]
                raw = b" " + texts[doc].encode()
                if any(entry.gather(ids.of(numbers[start:stop])[0]) != raw
                       for entry, ids in ((self.entry_a, self.ids_a), (self.entry_b, self.ids_b))):
                    keep[start:stop] = False
            numbers, ends = numbers[keep], np.cumsum(np.concatenate([[0], keep]))[ends]
        a, size_a = self.ids_a.of(numbers)
        b, size_b = self.ids_b.of(numbers)
        doc_ends = [np.concatenate([[0], np.cumsum(size)])[ends] for size in (size_a, size_b)]
        return Tokens(a, b, numbers, size_a, size_b, *doc_ends)

    def align(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(window numbers, end of each document's windows among them)."""
        a, b = tokens.a, tokens.b
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(len(tokens.ends_a), np.int64)
        windows = self.windows
        ends_a, ends_b = np.cumsum(windows.size_a[a]), np.cumsum(windows.size_b[b])
        # every document's tokens give the same bytes in A and B, so offsets run on over documents
        at_b = np.searchsorted(ends_b, ends_a)
        at_a = np.flatnonzero(ends_b[at_b] == ends_a)
        at_b = at_b[at_a]
        anchor = np.append(windows.space_a[a[1:]], True)[at_a] & np.append(windows.space_b[b[1:]], True)[at_b]
        cut_a, cut_b = at_a[anchor] + 1, at_b[anchor] + 1
        from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
        # windows that are a whole chunk
        chunk_a, chunk_b = np.cumsum(tokens.size_a), np.cumsum(tokens.size_b)
        of = np.searchsorted(chunk_a, cut_a)
        whole = ((chunk_a[of] == cut_a) & (chunk_b[of] == cut_b)
                 & (chunk_a[of] - tokens.size_a[of] == from_a) & (chunk_b[of] - tokens.size_b[of] == from_b))
        chunk = np.where(whole, tokens.chunks[of], -1)
        numbers = np.where(whole, self.window_of[chunk], -1)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            by_chunk, first = np.unique(chunk[unknown], return_index=True)
            first, by_chunk = first[by_chunk >= 0], by_chunk[by_chunk >= 0]
            asked = np.concatenate([unknown[first], unknown[chunk[unknown] < 0]])
            raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
            keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(*[
                (4 * v[asked]).tolist() for v in (from_a, cut_a, from_b, cut_b)], strict=True)]
            found = windows.numbers(keys)
            numbers[asked] = found
            self.window_of[by_chunk] = found[:len(by_chunk)]
            numbers = np.where(whole, self.window_of[chunk], numbers)
            # numbers of long windows hold for this step only
            self.window_of[by_chunk[found[:len(by_chunk)] >= windows.kept]] = -1
        return numbers, np.searchsorted(cut_a, tokens.ends_a, "right")


def _tables(entry: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte length of every id, and whether it begins with a space."""
    size, space = np.zeros(max(entry) + 1, np.int64), np.zeros(max(entry) + 1, bool)
    for i, t in entry.items():
        size[i], space[i] = len(t), t[:1] == b" "
    return size, space


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_FIGURES = common.schema("n_a long, n_b long, n_groups long, n_links long, groups string")
_PLACE = common.schema("block long, pair_at array<int>, times array<int>, pairs array<long>, holders array<int>")


class _Block:
    """Documents until their links fill a block."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.docs: list[tuple] = []                              # (n_a, n_b, n_groups, n_links, groups)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []     # (pair numbers, times)
        self.links = 0

    def add(self, windows: Windows, tokens: Tokens, numbers: np.ndarray, ends: np.ndarray, digest: bool) -> None:
        links, upto = windows.links_of(numbers)
        upto = np.append(0, upto)
        text, n_groups = windows.groups, np.append(0, np.cumsum(windows.n_groups[numbers]))
        numbers, starts = numbers.tolist(), np.append(0, ends[:-1])
        columns = [np.diff(tokens.ends_a, prepend=0), np.diff(tokens.ends_b, prepend=0), n_groups[ends] - n_groups[starts],
                   starts, ends, upto[starts], upto[ends]]
        for n_a, n_b, n, start, end, first, stop in zip(*[c.tolist() for c in columns], strict=True):
            groups = b";".join([text[i] for i in numbers[start:end]])
            groups = groups.decode() if not digest else hashlib.sha256(groups).hexdigest() if n else ""
            self.docs.append((n_a, n_b, n, stop - first, groups))
            self.pairs.append(np.unique(links[first:stop], return_counts=True))
        self.links += len(links)

    def out(self, number: int, pairs: list[int], schema: pa.Schema) -> list[pa.RecordBatch]:
        """The documents' rows, then one row with the block's pairs."""
        held = np.concatenate([p for p, _ in self.pairs])
        distinct, place, holders = np.unique(held, return_inverse=True, return_counts=True)
        ends = pa.array(np.cumsum([0] + [len(p) for p, _ in self.pairs]), pa.int32())
        times = np.concatenate([t for _, t in self.pairs])
        n = len(self.docs)
        columns = dict(zip([f.name for f in _FIGURES.fields], map(list, zip(*self.docs, strict=True)), strict=True))
        columns |= {"block": [number] * n, "pairs": [None] * n, "holders": [None] * n,
                    "pair_at": pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
                    "times": pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))}
        kept = pa.Table.from_batches(self.rows)
        docs = [kept.column(f.name).cast(f.type) if f.name not in columns else
                columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                for f in schema]
        block = {f.name: pa.nulls(1, f.type) for f in schema}
        block |= {"block": pa.array([number], pa.int64()),
                  "pairs": pa.array([[pairs[i] for i in distinct.tolist()]], schema.field("pairs").type),
                  "holders": pa.array([holders.tolist()], schema.field("holders").type)}
        return [*pa.table(docs, schema=schema).combine_chunks().to_batches(), *pa.table(block, schema=schema).to_batches()]


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of steps of STEP_CHARS, or of one longer text."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if i > first and size + n > STEP_CHARS:
            yield first, i - first
            first, size = i, 0
        size += n
    yield first, len(texts) - first


def blocks(docs: DataFrame, path_a: str, path_b: str, text: str, keep: list[str], digest: bool) -> DataFrame:
    """Rows of documents (``pairs`` null) and of their blocks (``pairs`` set)."""
    taken = {f.name for f in _FIGURES.fields + _PLACE.fields} | {"n_best", "count_sum"}
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in taken]
    names = [f.name for f in kept]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + _FIGURES.fields + _PLACE.fields)
    numbered = docs.select(*names, F.col(text).cast("string").alias("__text"), F.spark_partition_id().alias("__part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(f.name, t) for f, t in zip(out.fields, common.arrow_types(out), strict=True)])
        work, block, made, part = aligner(path_a, path_b), _Block(), 0, 0
        for whole in batches:
            for at, n in _steps(common.column(whole, "__text")) if whole.num_rows else ():
                batch = whole.slice(at, n)
                part = common.column(batch, "__part")[0].as_py()
                tokens = work.tokenise(common.str_texts(common.column(batch, "__text")))
                numbers, ends = work.align(tokens)
                # the partition number stands in for a table without kept columns
                block.rows.append(batch.select([*names, "__part"]))
                block.add(work.windows, tokens, numbers, ends, digest)
                if block.links >= BLOCK_LINKS:
                    yield from block.out(part << 32 | made, work.windows.pairs, schema)
                    block, made = _Block(), made + 1
                    work.windows.bound_pairs()
        if block.docs:
            yield from block.out(part << 32 | made, work.windows.pairs, schema)

    return numbered.mapInArrow(run, out)


STEP_CHARS = 500_000   # of the documents that are aligned in one step


def pair_counts(placed: DataFrame) -> DataFrame:
    """(pair, count, best): the documents that hold each pair, and the highest
    such count of the pair's A id."""
    counted = (placed.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
               .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count"))
               .withColumn("a", F.shiftright("pair", 32)))
    best = counted.groupBy("a").agg(F.max("count").alias("best"))
    return counted.join(best, "a").select("pair", "count", "best")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None,
          digest: bool = False) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;...``, or
    its SHA-256 with ``digest``), n_best, count_sum."""
    placed = common.stage(blocks(docs, path_a, path_b, text, keep or docs.columns, digest), "align-blocks")
    wanted = (placed.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair")))
    known = (wanted.join(pair_counts(placed), "pair")
             .groupBy(F.col("block").alias("of_block")).agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("known")))
    rows = placed.where("pairs is null").drop("pairs", "holders")
    names = [c for c in rows.columns if c not in ("block", "pair_at", "times", "groups")] + ["groups"]
    out = T.StructType([rows.schema[n] for n in names]
                       + common.schema("n_best long, count_sum long").fields)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        count = best = np.zeros(0, np.int64)
        if right.num_rows:
            known = right.column("known").combine_chunks().flatten()
            count, best = known.field("count").to_numpy(), known.field("best").to_numpy()
        at, times = _flat(left, "pair_at"), _flat(left, "times")
        sizes = left.column("pair_at").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(left.num_rows), sizes)
        n_best = np.zeros(left.num_rows, np.int64)
        total = np.zeros(left.num_rows, np.int64)
        np.add.at(n_best, doc, times * (count[at] == best[at]))
        np.add.at(total, doc, times * count[at])
        return pa.table([*[left.column(n) for n in names], pa.array(n_best), pa.array(total)],
                        names=[f.name for f in out.fields])

    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(finish, out)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
