"""Nearest neighbours by a block matrix join on int8 codes.

Vectors are scaled to unit length and quantised to int8 with one scale each;
the length of what quantisation removed bounds its error. Queries and
candidates are packed into blocks; every query block meets every candidate
block of its dimension once. A tile's int8 matrix product gives all cosines
within err_q + err_c; pairs whose upper bound stays below a query's k-th best
lower bound (or its k-th best score so far) go, the others are recomputed in
double precision on the original vectors and kept in a heap per query. A
window merges the heaps of the tasks. The result is exact.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part; vectors meet only those of their dimension; rows
with one vec_id are one vector (the smallest array); null ids take no part;
ties go to the smaller vec_id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEAREST = 5
BLOCK = 1024       # vectors of a block
LEVELS = 127       # largest code
ROUNDING = 1e-9    # slack for float rounding in the bounds
PAIRS_AT_ONCE = 50_000

_BLOCK = "dim int, ids binary, codes binary, scales binary, errors binary, vectors binary"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row (id, vector as doubles) for each usable vec_id."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors) of the unit vectors of the rows: the unit vector
    is scale * codes within error (Euclidean)."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scales = np.abs(unit).max(axis=1) / LEVELS
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    lost = unit - codes * scales[:, None]
    return codes, scales, np.sqrt((lost * lost).sum(axis=1)) + ROUNDING


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, v) rows packed into rows of up to ``size`` vectors of one dimension."""
    def emit(dim: int, ids: list, rows: list) -> pa.RecordBatch:
        x = np.array(rows, np.float64)
        codes, scales, errors = quantise(x)
        values = [[dim], *([a.tobytes()] for a in (np.array(ids, np.int64), codes, scales, errors, x))]
        types = [pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)],
                                          names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids, rows = waiting.setdefault(len(v), ([], []))
                    ids.append(i)
                    rows.append(v)
                    if len(ids) == size:
                        yield emit(len(v), ids, rows)
                        del waiting[len(v)]
        for dim, (ids, rows) in waiting.items():
            yield emit(dim, ids, rows)

    return vectors.select("id", "v").mapInArrow(run, _BLOCK)


def cosines(a: np.ndarray, b: np.ndarray, scaled: bool = False) -> np.ndarray:
    """Cosine of each row of a with that row of b; sums run over the components in order."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    with np.errstate(all="ignore"):
        got = dot / np.sqrt(aa * bb)
    out = ~np.isfinite(got) | (aa * bb < 1e-300)  # squares out of range: the same on scaled vectors
    if out.any() and not scaled:
        low, high = (x[out] / np.abs(x[out]).max(axis=1, keepdims=True) for x in (a, b))
        got[out] = cosines(low, high, scaled=True)
    return got


class _Side:
    def __init__(self, dim: int, ids: bytes, codes: bytes, scales: bytes, errors: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        product = np.float32 if dim * LEVELS * LEVELS < 1 << 24 else np.float64  # sums of int8 products stay exact
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim).astype(product)
        self.scales, self.errors = np.frombuffer(scales), np.frombuffer(errors)
        self.vectors = np.frombuffer(vectors).reshape(-1, dim)


def search_tile(q: _Side, c: _Side, heaps: dict[int, list], nearest: int) -> None:
    """Update each query's heap of (score, -vec_id) with one tile."""
    estimate = (q.codes @ c.codes.T).astype(np.float64)
    estimate *= q.scales[:, None]
    estimate *= c.scales[None, :]
    bound = q.errors[:, None] + (1 + q.errors[:, None]) * c.errors[None, :]
    own = q.ids[:, None] == c.ids[None, :]
    low = np.where(own, -np.inf, estimate - bound)
    least = np.full(len(q.ids), -np.inf)
    if low.shape[1] >= nearest:
        least = np.partition(low, -nearest, axis=1)[:, -nearest]
    for i, query in enumerate(q.ids.tolist()):
        heap = heaps.setdefault(query, [])
        if len(heap) == nearest:
            least[i] = max(least[i], heap[0][0])
    i, j = np.nonzero((estimate + bound >= least[:, None] - ROUNDING) & ~own)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        qi, cj = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
        scores = cosines(q.vectors[qi], c.vectors[cj])
        for query, vec, score in zip(q.ids[qi].tolist(), c.ids[cj].tolist(), scores.tolist(), strict=True):
            heap = heaps[query]
            if len(heap) < nearest:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))


def nearest_neighbours(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
                       nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (over the
    column ``id``) holds, against all others."""
    rows = common.stage(usable(vectors, key, vector), "ann-vectors")
    queries = rows.where(is_query)
    n_blocks = -(-max(1, queries.count()) // block)
    query_blocks = blocks(queries.repartition(n_blocks, "id"), block)
    query_blocks = common.stage(query_blocks.withColumn("part", F.spark_partition_id()), "ann-queries")
    names = [c.split()[0] for c in _BLOCK.split(", ")][1:]
    left = query_blocks.select("dim", "part", *[F.col(n).alias(f"q_{n}") for n in names])
    # every candidate block goes to each part of the query set
    right = blocks(rows, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tiles = right.join(left, ["dim", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                search_tile(_Side(row["dim"], *(row[f"q_{n}"] for n in names)),
                            _Side(row["dim"], *(row[n] for n in names)), heaps, nearest)
        found = [(q, -v, s) for q, heap in heaps.items() for s, v in heap]
        for at in range(0, len(found), 10_000):
            part = list(zip(*found[at:at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()),
                                              pa.array(part[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
