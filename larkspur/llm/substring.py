"""Substring dedup by chains of content-defined chunks.

A gear hash rolls over the words of a text (h = 2 h + gear(word)); a chunk
ends where the low bits of h are zero, so a cut depends only on the last few
words and the chunks of a passage are the same wherever it stands, whatever was
inserted before. Chunks have LEAST to MOST words and a digest each.

From each chunk on, the chunks that follow until CHAIN words are reached are a
chain, named by one digest of its chunk digests in order; one more chain ends
with the text. Spark keeps, for every chain, the smallest doc_id that holds it;
in all other documents its chunks are repeated and removed. So chunks go only
where one earlier document holds the same chunks in a row, CHAIN words or more,
and the first document of a chain keeps them. Repeated chains that touch are one
passage; its chains may have different first documents.

A chance collision of two 64-bit digests removes one chain: about n / 2 ** 64
for each of n chains.

Defined results: null text stays null, an empty one empty; a document that is
one repeated passage becomes empty but stays; repeated rows (one key, one
text) count as one document and stay alike, as do rows with one key and
different texts; a null key takes no part; passages repeated
only within a document stay; of documents that tie nothing is asked but the
smaller doc_id; an empty table gives no rows; other columns pass through. A very
long text is chunked in one task, in arrays of a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import WordHashes, mix

LEAST = 2        # words of a chunk at least,
MOST = 12        # and at most
MASK = 3         # a cut where the low bits of the gear hash are zero: one word in four
CHAIN = 25       # words at least of chunks in a row that make a passage

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(common.SPACE)] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(256)], np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_cache: list[WordHashes] = []


def _words() -> WordHashes:
    if not _cache:
        _cache.append(WordHashes())
    return _cache[0]


def cut_points(gear: np.ndarray, least: int = LEAST, most: int = MOST, mask: int = MASK) -> np.ndarray:
    """Ends (exclusive, in words) of the chunks. The low bits of the rolling
    hash depend on as many words as the mask has bits."""
    h = np.zeros(len(gear), np.uint64)
    for j in range(mask.bit_length()):
        h[j:] += gear[:len(gear) - j] << np.uint64(j)
    ends = np.flatnonzero((h & np.uint64(mask)) == 0) + 1
    out, start, n = [], 0, len(gear)
    at, ends = 0, [*ends.tolist(), n]
    while start < n:
        while ends[at] < start + least and ends[at] < n:
            at += 1
        start = min(ends[at], start + most, n)
        out.append(start)
    return np.array(out, np.int64)


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and last byte (exclusive) of the words."""
    space = _IS_SPACE[np.frombuffer(text, np.uint8)]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, words, first byte, last byte exclusive) of the chunks."""
    words = text.split()
    if not words:
        none = np.empty(0, np.int64)
        return none, none, none, none
    gear = _words().of(words)
    begins, stops = _word_bounds(text)
    ends = cut_points(mix(gear))
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(gear)) - np.repeat(starts, ends - starts)
    digest = mix(np.add.reduceat(gear * _POWERS[place], starts) + (ends - starts).astype(np.uint64))
    return digest.view(np.int64), ends - starts, begins[starts], stops[ends - 1]


def chains(text: bytes, width: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first word, word after the last) of the chains of chunks."""
    digest, words, *_ = chunks(text)
    ends = np.cumsum(words)
    if not len(ends) or ends[-1] < width:
        none = np.empty(0, np.int64)
        return none, none, none
    starts = ends - words
    first = np.flatnonzero(starts + width <= ends[-1])
    last = np.searchsorted(ends, starts[first] + width)
    first, last = np.append(first, first[-1]), np.append(last, len(ends) - 1)   # the last one ends with the text
    # sum of digest * FACTOR ** (place in the chain), from sums over the text
    steps = np.full(len(ends), _FACTOR)
    steps[0] = 1
    power = np.cumprod(steps)
    steps[1:] = _INVERSE
    inverse = np.cumprod(steps)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest.view(np.uint64) * power)])
    value = (upto[last + 1] - upto[first]) * inverse[first]
    return mix(value + (last - first).astype(np.uint64)).view(np.int64), starts[first], ends[last]


HELD = T.StructType([T.StructField("doc", T.LongType()), T.StructField("digest", T.LongType())])


def chain_table(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = CHAIN) -> DataFrame:
    """(doc, digest): one row for each distinct chain of each text."""
    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = pa.schema([("doc", pa.int64()), ("digest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, common.BATCH_ROWS):
                batch = whole.slice(at, common.BATCH_ROWS)
                made = [np.unique(chains(t, width)[0]) for t in common.byte_texts(common.column(batch, "text"))]
                rows = np.repeat(np.arange(len(made)), [len(m) for m in made])
                yield pa.RecordBatch.from_arrays(
                    [common.column(batch, "doc").take(pa.array(rows)), pa.array(np.concatenate(made))], schema=schema)

    return source.mapInArrow(run, HELD)


def repeated_chains(table: DataFrame) -> DataFrame:
    """_doc and, for its chains that a smaller doc_id holds too, (_chains) the
    list of (digest, first)."""
    firsts = (table.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
              .where("first < last").drop("last"))
    hits = table.join(firsts, "digest").where("doc > first")
    return hits.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("digest", "first")).alias("_chains"))


def passages(text: bytes, repeated: list[dict], width: int) -> list[tuple[int, int, int, list[int]]]:
    """(begin, stop, words, first documents) of the repeated chains, those that
    touch as one."""
    first = {r["digest"]: r["first"] for r in repeated}
    joined: list[tuple[int, int, set[int]]] = []
    for digest, start, stop in zip(*(a.tolist() for a in chains(text, width)), strict=True):
        if digest not in first:
            continue
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]), joined[-1][2] | {first[digest]})
        else:
            joined.append((start, stop, {first[digest]}))
    if not joined:
        return []
    begins, stops = _word_bounds(text)
    return [(int(begins[a]), int(stops[b - 1]), b - a, sorted(docs)) for a, b, docs in joined]


def cut(text: bytes, spans: list[tuple]) -> bytes:
    """The text without the spans and the white space before each."""
    out, at = [], 0
    for begin, stop, *_ in spans:
        out.append(text[at:begin].rstrip() if at or text[at:begin].strip() else b"")
        at = stop
    rest = text[at:]
    return b"".join(out) + (rest if any(out) else rest.lstrip()) if spans else text


RESULT = T.StructType([
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType()),
        T.StructField("words", T.IntegerType()), T.StructField("first_docs", T.ArrayType(T.LongType()))])))])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chain_words: int = CHAIN) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and ``passages``:
    byte spans of the original text, their words and the documents that keep
    them."""
    repeated = repeated_chains(chain_table(docs, key, text, chain_words))  # hashing again is cheaper than moving spans
    joined = docs.drop("passages").withColumn("_doc", F.col(key).cast("long")).join(repeated, "_doc", "left")
    added = T.StructType([docs.schema[text], *RESULT.fields])

    def compute(batch):
        texts, spans = [], []
        raw = common.column(batch, text).cast(pa.binary()).to_pylist()
        for t, found in zip(raw, common.column(batch, "_chains").to_pylist(), strict=True):
            cuts = passages(t, found, chain_words) if found and t else []
            texts.append(cut(t, cuts).decode() if cuts else None if t is None else t.decode())
            spans.append([dict(zip(("begin", "stop", "words", "first_docs"), c, strict=True)) for c in cuts])
        return [texts, spans]

    out = common.with_columns(joined, added, compute, keep=docs.columns)
    return out.select(*[c for c in docs.columns if c != "passages"], "passages")
