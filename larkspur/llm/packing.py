"""Packing tokenised documents into sequences by linear grouping.

Only the counts of each length (at most CAPACITY of them) reach the driver;
the plan is made on that histogram and its size depends on the number of
lengths, not of documents.

1. Lengths above SMALL are sorted and cut into GROUPS groups of equal
   cardinality; each is rounded up to the largest of its group.
2. The few sizes make a configuration program: column generation (knapsack
   pricing) solves its relaxation, configurations are used a whole number of
   times, and the rest (fewer than the sizes) goes by best fit.
3. Actual lengths take the places of the rounded ones, which leaves gaps.
4. Small lengths, longest first, are put where they fit best.

Documents of one length are interchangeable: a document takes the place of
its rank within its length. Ranks are counted within salted parts of a length
and shifted by the counts before, so a hot length is spread over tasks.

Defined results: null text is the empty document (only the end token); repeated
rows are packed each for itself; an empty table gives no rows; input columns
other than the key and the text are ignored unless kept by the caller; a
document longer than CAPACITY is cut, its first piece may be shorter.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .fast_chunks import ChunkEncoder

CAPACITY = 2048
END_ID = 0
SMALL = CAPACITY // 3
GROUPS = 320
RANK_ROWS = 256  # rows of one length that one salted part holds on average


# -- tokenising ------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means:
    printable Latin-1 bytes stand for themselves, the others, in order, for
    the code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_level_encoder(path: str) -> ChunkEncoder:
    """Encoder of a ``tokenizers`` byte-level BPE file whose ids are merge ranks:
    the same ids as that library gives with add_special_tokens=False (its
    special strings inside a text included), as little-endian 32-bit numbers."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = byte_alphabet()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens=special)

    def encode(text: str) -> bytes:
        return np.array(bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    return ChunkEncoder(encode, tuple(special))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
             capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece, start, length, ids (little-endian
    unsigned 32-bit numbers; END_ID ends each document)."""
    key_field = docs.schema[key]
    out = T.StructType([key_field, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    names = [f.name for f in out.fields]
    types = common.arrow_types(T.StructType(out.fields[1:]))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, common.BATCH_ROWS):
                batch = whole.slice(at, common.BATCH_ROWS)
                rows, pieces = [], []
                for i, t in enumerate(common.str_texts(common.column(batch, text))):
                    ids = encode(t) + end
                    for p, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                        rows.append(i)
                        pieces.append((p, start, n, ids[4 * start:4 * (start + n)]))
                keys = common.column(batch, key).take(pa.array(rows, pa.int64()))
                columns = zip(*pieces, strict=True) if pieces else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [keys] + [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(key, text).mapInArrow(run, out)


# -- the plan --------------------------------------------------------------

class Place(NamedTuple):
    """Documents of ``length`` with ranks from ``rank`` on go, one each, into
    ``count`` sequences from ``sequence`` on, at ``offset``."""
    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def equal_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) from long to short, cut into groups of equal
    cardinality; groups with the same largest length are one."""
    total = sum(counts.values())
    size = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                if not out or out[-1][0][0] != length:
                    out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the largest value (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    used = []
    for s, v in zip(sizes, value, strict=True):
        copies = np.zeros(capacity + 1, np.int64)
        if v > 1e-12:
            base = best.copy()
            for c in range(1, capacity // s + 1):
                with_c = base[:capacity + 1 - c * s] + c * v
                better = with_c > best[c * s:] + 1e-12
                best[c * s:][better] = with_c[better]
                copies[c * s:][better] = c
        used.append(copies)
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    for i in range(len(sizes) - 1, -1, -1):
        pattern[i] = used[i][room]
        room -= pattern[i] * sizes[i]
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover the demand exactly: the relaxation by
    column generation, rounded down, and best fit for what is left."""
    s, b = np.array(sizes, np.int64), np.array(demand, float)
    columns = np.diag(capacity // s).astype(float)
    x = b / np.diag(columns)
    for _ in range(rounds):
        dual = np.linalg.solve(columns.T, np.ones(len(s)))
        pattern = _best_pattern(s, dual, capacity)
        if pattern @ dual <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, pattern.astype(float))
        up = step > 1e-9
        ratio = np.full(len(s), np.inf)
        ratio[up] = np.maximum(x[up], 0) / step[up]
        leave = int(np.argmin(ratio))
        x = x - ratio[leave] * step
        x[leave] = ratio[leave]
        columns[:, leave] = pattern
    out, left = [], np.array(demand, np.int64)
    for j in np.argsort(-x):
        pattern = columns[:, j].astype(np.int64)
        held = pattern > 0
        times = min(int(x[j] + 1e-6), int((left[held] // pattern[held]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    rest: list[tuple[int, np.ndarray]] = []  # (room, pattern), sorted by room
    for i, n in enumerate(left):
        for _ in range(int(n)):
            at = bisect.bisect_left(rest, sizes[i], key=lambda r: r[0])
            room, pattern = rest.pop(at) if at < len(rest) else (capacity, np.zeros(len(s), np.int64))
            pattern = pattern.copy()
            pattern[i] += 1
            bisect.insort(rest, (room - sizes[i], pattern), key=lambda r: r[0])
    return out + [(pattern, 1) for _, pattern in rest]


class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.places, self.next_rank, self.sequences = capacity, [], {}, 0
        self.by_room: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, count)
        self.rooms: list[int] = []

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.next_rank.get(length, 0)
        self.places.append(Place(length, rank, count, sequence, offset))
        self.next_rank[length] = rank + count

    def open(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences that each begin with these lengths."""
        offset = 0
        for length in lengths:
            self.place(length, count, self.sequences, offset)
            offset += length
        self.keep(self.capacity - offset, self.sequences, count)
        self.sequences += count

    def keep(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.by_room:
                bisect.insort(self.rooms, room)
            self.by_room.setdefault(room, []).append((sequence, count))

    def fit(self, length: int, count: int) -> None:
        """Best fit of ``count`` documents of one length: a sequence that got
        one is the tightest for the next, until it is full."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = min(count, self.capacity // length)
                self.open([length] * each, count // each)
                count -= count // each * each
                continue
            room = self.rooms[at]
            sequence, there = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            each = min(count, room // length)
            many = min(there, count // each)
            for j in range(each):
                self.place(length, many, sequence, self.capacity - room + j * length)
            count -= many * each
            self.keep(room - each * length, sequence, many)
            self.keep(room, sequence + many, there - many)


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[list[Place], int]:
    """Places for every document of the histogram, and the number of sequences."""
    made = _Plan(capacity)
    large = {n: c for n, c in counts.items() if n > small}
    runs = equal_groups(large, groups)
    if runs:
        queues = [[list(r) for r in reversed(g)] for g in runs]  # the longest at the end
        sizes, demand = [g[0][0] for g in runs], [sum(c for _, c in g) for g in runs]
        for pattern, times in configurations(sizes, demand, capacity):
            held = [(i, int(pattern[i])) for i in np.flatnonzero(pattern)]
            while times:
                many = min(times, *(queues[i][-1][1] // each for i, each in held), times)
                lengths = []
                for i, each in held:
                    if many:
                        lengths += [queues[i][-1][0]] * each
                        queues[i][-1][1] -= each * many
                    for _ in range(0 if many else each):  # one sequence across two runs
                        lengths.append(queues[i][-1][0])
                        queues[i][-1][1] -= 1
                        if not queues[i][-1][1]:
                            queues[i].pop()
                    if many and not queues[i][-1][1]:
                        queues[i].pop()
                made.open(lengths, max(many, 1))
                times -= max(many, 1)
    for length in sorted((n for n in counts if n <= small), reverse=True):
        made.fit(length, counts[length])
    return made.places, made.sequences


# -- placing ---------------------------------------------------------------

def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, small: int = SMALL,
         groups: int = GROUPS) -> DataFrame:
    """``pieces`` (staged; key, piece, length and any other columns) with
    sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    places, _ = plan(counts, capacity, small, groups)
    by_length: dict[int, list] = {n: [] for n in counts}
    for p in places:
        by_length[p.length].append((p.rank, p.sequence, p.offset))
    table = spark.createDataFrame(
        [(n, 1 + counts[n] // RANK_ROWS, sorted(v)) for n, v in by_length.items()],
        "length long, _parts int, _places array<struct<rank: long, sequence: long, offset: long>>")
    own = pieces.columns
    # the table has one row per length: bounded by the capacity
    salted = (pieces.join(F.broadcast(table.select("length", "_parts")), "length")
              .withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.col("_parts")).cast("int")))
    before = (salted.groupBy("length", "_salt").count()
              .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count"))
              .drop("count"))
    in_part = Window.partitionBy("length", "_salt").orderBy(key, "piece", F.xxhash64(*own))
    ranked = (salted.withColumn("_row", F.row_number().over(in_part))
              .join(before, ["length", "_salt"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1))
    put = ranked.join(F.broadcast(table.select("length", "_places")), "length").withColumn(
        "_place", F.element_at(F.filter("_places", lambda p: p["rank"] <= F.col("_rank")), -1))
    return put.select(*own, (F.col("_place.sequence") + F.col("_rank") - F.col("_place.rank")).alias("sequence_id"),
                      F.col("_place.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of whole sequences, from a :func:`pack` that
    kept ids. A sequence holds at most the capacity."""
    held = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return held.select("sequence_id", "length", F.aggregate(
        "_parts", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"])).alias("ids"))
