"""Byte-level BPE with a segment tree, and its inverse.

The pieces of a text (matches of the pre-tokenisation pattern) are encoded one
by one. A segment tree over a piece's byte positions stores the leftmost
minimum rank of the pairs that begin there; its root names the next merge.
A merge updates three leaves, those of the live pair itself, of its right
part and of its live left neighbour, each in logarithmic time. Chunks that
came before are looked up; the new pieces of a batch of texts keep their
trees as rows of one array and merge in step, long pieces each for itself.

Defined results: null text is empty, without ids; decoding gives the bytes of
the text back; unknown ids are an error; repeated rows are encoded alike; an
empty table gives no rows; other columns pass through, those named like a
result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .fast_chunks import ChunkEncoder, Encoded

# The characters of the Unicode property White_Space, which \s
# means in the pattern.
WHITE_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
_NEVER = 1 << 62


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def piece_pattern(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelled out."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(spelled.replace(r"\s", f"[{WHITE_SPACE}]"))


# Stand-ins of a letter, a number and neither, beyond ASCII.
_LETTER, _NUMBER, _OTHER = "é", "٣", "€"


@lru_cache(maxsize=4)
def _kinds(pattern: str) -> dict[str, str]:
    """Stand-in of each code point that the interpreter does not know, by what
    the tokenizer library takes it for: under a vocabulary in which a letter (or
    digit) merges with the byte after it, it does so within a piece only."""
    import tiktoken
    leads = range(0xC2, 0xF5)
    ranks = {bytes([b]): b for b in range(256)}
    for at, first in enumerate((b"x", b"1")):
        ranks |= {first + bytes([b]): 256 + 64 * at + b - 0xC2 for b in leads}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    unknown = [c for c in map(chr, [*range(0x40000), *range(0xE0000, 0xF0000)]) if unicodedata.category(c) == "Cn"]
    return {c: _LETTER if probe.encode_ordinary("x" + c)[0] > 255 else
            _NUMBER if probe.encode_ordinary("1" + c)[0] > 255 else _OTHER for c in unknown}


def split_pieces(text: str, pieces: regex.Pattern, pattern: str) -> list[str]:
    """The matches of the pattern, as the tokenizer library sees its classes."""
    if text.isascii() or not common.unassigned().search(text):
        return pieces.findall(text)
    kinds = _kinds(pattern)
    known = common.unassigned().sub(lambda m: kinds.get(m[0], _OTHER), text)
    return [text[m.start():m.end()] for m in pieces.finditer(known)]


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # tree[1] is the root, tree[size + i] the pair that begins at byte i, as rank * size + i
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    after = list(range(1, n + 1))       # where the part that begins at i ends
    before = list(range(-1, n))         # where the part before the one at i begins

    def update(i: int, key: int) -> None:
        node = size + i
        tree[node] = key
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            key = key if key <= other else other
            if tree[node] == key:
                break
            tree[node] = key

    def pair(i: int, middle: int) -> int:
        if middle >= n:
            return _NEVER
        rank = ranks.get(piece[i:after[middle]])
        return _NEVER if rank is None else rank * size + i

    while tree[1] != _NEVER:
        i = tree[1] % size
        right = after[i]
        end = after[i] = after[right]
        before[end] = i
        update(right, _NEVER)
        update(i, pair(i, end))
        if before[i] >= 0:
            update(before[i], pair(before[i], i))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class PieceMerger:
    """Ids of many pieces under one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Leaves rank * size + position of adjacent parts."""
        wanted = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.merged[place] * size + at, _NEVER)

    def _rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most ``size`` bytes: a tree per row, merged in step."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        place = np.arange(size)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        ids = self.byte[raw]
        live = place[None, :] < length[:, None]
        after = np.where(place[None, :] + 1 < length[:, None], place[None, :] + 1, size)
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), _NEVER, np.int64)
        pair = self._pair(ids[:, :-1], ids[:, 1:], place[None, :-1], size)
        tree[:, size:-1] = np.where(after[:, :-1] < size, pair, _NEVER)
        width = size
        while width > 1:
            tree[:, width // 2:width] = np.minimum(tree[:, width:2 * width:2], tree[:, width + 1:2 * width:2])
            width //= 2
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < _NEVER]
            if not len(rows):
                break
            at, rank = tree[rows, 1] % size, tree[rows, 1] // size
            right = after[rows, at]
            end = after[rows, right]
            ids[rows, at], after[rows, at], live[rows, right] = rank, end, False
            has = end < size
            before[rows[has], end[has]] = at[has]
            leaf = np.full(len(rows), _NEVER)
            leaf[has] = self._pair(rank[has], ids[rows[has], end[has]], at[has], size)
            tree[rows, size + right], tree[rows, size + at] = _NEVER, leaf
            left = before[rows, at]
            some = left >= 0
            tree[rows[some], size + left[some]] = self._pair(ids[rows[some], left[some]], rank[some], left[some], size)
            nodes = [(rows, size + right), (rows, size + at), (rows[some], size + left[some])]
            for _ in range(size.bit_length() - 1):
                nodes = [(r, node >> 1) for r, node in nodes]
                for r, node in nodes:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        flat = ids[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > TOGETHER:
                out[i] = np.array(merge_piece(piece, self.ranks), "<u4").tobytes()
            elif piece:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, rows in classes.items():
            for start in range(0, len(rows), ROWS_AT_ONCE):
                part = rows[start:start + ROWS_AT_ONCE]
                for i, got in zip(part, self._rows([pieces[i] for i in part], size), strict=True):
                    out[i] = got
        return out


TOGETHER = 128         # bytes of a piece that shares an array with others
ROWS_AT_ONCE = 4096


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    ranks, pieces = load_ranks(path), piece_pattern(pattern)
    merge = PieceMerger(ranks)
    known = Encoded(lambda piece: merge([piece.encode()])[0])

    def encode_many(texts: list[str]) -> list[bytes]:
        found = [split_pieces(t, pieces, pattern) for t in texts]
        known.fill({p for f in found for p in f}, lambda new: merge([p.encode() for p in new]))
        return [b"".join(map(known.__getitem__, f)) for f in found]

    return ChunkEncoder(lambda text: encode_many([text])[0], encode_many=encode_many)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the array of token ids of every whole text."""
    def compute(batch):
        encoded = encoder(path, pattern)
        parts = encoded.all(common.str_texts(common.column(batch, text)))
        ends = np.cumsum([0] + [len(p) // 4 for p in parts])
        values = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]

    return common.with_columns(docs, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), compute, keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that each array of ids stands for."""
    def compute(batch):
        token = _tokens(path).__getitem__
        return [[None if row is None else b"".join(map(token, row)) for row in common.column(batch, ids).to_pylist()]]

    return common.with_columns(encoded, T.StructType([T.StructField(out, T.BinaryType())]), compute)


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


class ByteTable:
    """Byte strings by number, end to end, to be gathered for whole arrays."""

    def __init__(self, strings: dict[int, bytes]):
        top = max(strings) + 1
        sizes = np.zeros(top, np.int64)
        for i, t in strings.items():
            sizes[i] = len(t)
        self.ends = np.cumsum(sizes)
        self.starts, self.sizes = self.ends - sizes, sizes
        self.flat = np.frombuffer(b"".join(strings.get(i, b"") for i in range(top)), np.uint8)

    def gather(self, numbers: np.ndarray) -> bytes:
        return self.placed(numbers)[0]

    def placed(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings end to end, and where each ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)
        return self.flat[at].tobytes(), ends


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[ByteTable, ByteTable]:
    tokens = _tokens(path)
    return ByteTable(tokens), ByteTable({i: b",%d" % i for i in tokens})


GATHER = 1 << 18    # ids that are turned into bytes in one step


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, the SHA-256 of the decimal ids joined by commas
    (ids_sha256) and of the bytes that the ids decode to (decoded_sha256):
    encoded and decoded in one pass, without moving the ids."""
    def compute(batch):
        encoded, (tokens, decimals) = encoder(path, pattern), _tables(path)
        rows = []
        for part in encoded.all(common.str_texts(common.column(batch, text))):
            ids = np.frombuffer(part, "<u4")
            listed, decoded = hashlib.sha256(), hashlib.sha256()
            for start in range(0, len(ids), GATHER):
                step = ids[start:start + GATHER]
                written = decimals.gather(step)
                listed.update(written if start else written[1:])
                decoded.update(tokens.gather(step))
            rows.append((len(ids), listed.hexdigest(), decoded.hexdigest()))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]

    return common.with_columns(docs, common.schema("n_tokens long, ids_sha256 string, decoded_sha256 string"), compute, keep)
