"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every text becomes its set of hashed 5-word shingles; equal sets are one
   class with the smallest doc_id as representative. The K smallest hashes of
   the set are its sketch.
2. Inverted lists over the retained values generate overlaps. Linked sets
   share at least ``_required`` retained values, so by the prefix principle
   each document needs only its rarest ``sketch - required + 1`` values as
   list keys: values that many documents share are keys only of documents
   made mostly of them.
3. Every list links its members to a hub (the member with the most shared
   values). The union sketch of a pair, the K smallest of both, estimates its
   similarity; pairs far below the threshold go. Exact Jaccard on full sets
   confirms the rest.
4. Lists whose members now lie in two or more components are compared in
   blocks of at most BLOCK members: sketch overlaps select the pairs, full
   sets decide inside the task. A block returns only links that join
   components, so a group of m near copies never becomes m * m rows.

Links are exact (full sets of 64-bit shingle hashes). A true link is missed
only if its two sketches share fewer values than ``_required``, with
probability at most MISS.

Defined results: null or empty texts have an empty set and link with nothing;
a text shorter than five words is one shingle; repeated rows and equal sets
are linked; rows with one doc_id but different texts are one document whose
links are those of all its texts; rows with a null doc_id take no part
(component_id null, kept true); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .quality import binomial_cdf
from .shingles import WordHashes, shingle_set

WIDTH = 5
PERCENT = 85        # link when 100 * intersection >= PERCENT * union
K = 64              # values that a sketch retains
MISS = 1e-9         # chance to miss one link at the threshold
BLOCK = 2048        # members of a list that one task compares at once
VALUES_AT_ONCE = 4096

_cache: list[WordHashes] = []


def _hashes(text: bytes, width: int) -> np.ndarray:
    if not _cache:
        _cache.append(WordHashes())
    return shingle_set(_cache[0].of(text.lower().split()), width)  # bytes.lower: A-Z only


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _least_shared(n: int, percent: int) -> int:
    """The largest t with P(Binomial(n, percent/100) < t) <= MISS."""
    t = 0
    while t < n and binomial_cdf(t, n, percent / 100) <= MISS:
        t += 1
    return t


def _required(sketch: Column, n_shingles: Column, k: int, percent: int) -> Column:
    """Values that a document's sketch shares with that of any linked one. A
    set no larger than k is its own sketch: there the bound is certain."""
    whole = F.ceil(F.lit(percent) * n_shingles / F.lit(100.0))
    return F.least(F.lit(_least_shared(k, percent)), whole).cast("int")


SIGNATURE = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
                          T.StructField("sketch", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """Set size, digest of the whole set and bottom-k sketch of every text."""
    def compute(batch):
        sizes, digests, sketches = [], [], []
        for t in common.byte_texts(common.column(batch, text)):
            s = _hashes(t, width)
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            sketches.append(s[:k].tolist())
        return [sizes, digests, sketches]

    return common.with_columns(docs.select(key, text), SIGNATURE, compute, keep=[key])


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union sketch that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _cutoff(k: int, percent: int) -> float:
    return _least_shared(k, percent) / k


def list_members(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, df, cls, shared, earlier): the inverted lists with two members or
    more, each class under the rarest values it needs as keys, in the order of
    (df, value); ``earlier`` are its keys before this one."""
    postings = classes.select("cls", F.explode("sketch").alias("value"))
    counts = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = (postings.join(counts, "value").groupBy("cls")
              .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("keys")))  # at most k entries
    needed = F.size("sketch") - _required(F.col("sketch"), F.col("n_shingles"), k, percent) + 1
    alone = F.size("sketch") - F.size("keys")
    # values that no other class retains are the rarest keys; they fill the prefix first
    keys = classes.join(shared, "cls").withColumn("take", needed - alone).where("take > 0")
    taken = F.slice("keys", F.lit(1), F.greatest("take", F.lit(0)))
    lists = keys.select("cls", F.size("keys").alias("shared"), taken.alias("keys"))
    return lists.select("cls", "shared", "keys", F.posexplode("keys").alias("at", "key")).select(
        F.col("key.value").alias("value"), F.col("key.df").alias("df"), "cls", "shared",
        F.slice("keys.value", F.lit(1), F.col("at")).alias("earlier"))


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Full shingle sets of the wanted classes, recomputed from the text of
    their representatives."""
    reps = classes.join(wanted, "cls", "left_semi").select("cls", "digest", F.col("rep").alias("_rep"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(reps, F.col("_key") == F.col("_rep"))

    def compute(batch):
        sets = [_hashes(t, width) for t in common.byte_texts(common.column(batch, "_text"))]
        digests = common.column(batch, "digest").to_pylist()
        return [[s.tobytes() if len(s) and _digest(s) == d else None for s, d in zip(sets, digests, strict=True)]]

    added = T.StructType([T.StructField("shingles", T.BinaryType())])
    return common.with_columns(texts, added, compute, keep=["cls"]).where("shingles IS NOT NULL")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    full = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [_linked(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), percent)
                    for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True)]
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return full.mapInPandas(run, "a long, b long").distinct()


class _Forest(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = counts > 1
    place = np.cumsum(twice) - 1
    row, at = row[twice[codes]], place[codes[twice[codes]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(at, np.arange(0, int(twice.sum()) + VALUES_AT_ONCE, VALUES_AT_ONCE))
    for start, stop in zip(edges, edges[1:], strict=False):
        held = np.zeros((len(sets), VALUES_AT_ONCE), np.float32)
        held[row[start:stop], at[start:stop] % VALUES_AT_ONCE] = 1
        out += held @ held.T
    return out


def _block_links(pdf: pd.DataFrame, k: int, percent: int) -> list[tuple[int, int]]:
    """Links between different components within one pair of blocks of one
    list; of several that join the same components, one. A pair is compared
    in the first list that both are in."""
    pdf = pdf.drop_duplicates("cls").sort_values("cls", ignore_index=True)
    comps = pdf["component"].to_numpy()
    if len(np.unique(comps)) < 2:
        return []
    sets = [np.frombuffer(x, np.int64) for x in pdf["shingles"]]
    size = np.array([len(s) for s in sets], np.int64)
    least = np.minimum(_least_shared(k, percent), np.ceil(percent * size / 100.0))
    possible = _shared([s[:k] for s in sets]) >= np.maximum(least[:, None], least[None, :])
    possible &= 100 * size[:, None] >= percent * size[None, :]
    possible &= 100 * size[None, :] >= percent * size[:, None]
    possible &= comps[:, None] != comps[None, :]
    earlier = [np.asarray(e, np.int64) for e in pdf["earlier"]]
    if any(len(e) for e in earlier):
        possible &= _shared(earlier) == 0
    rows = np.flatnonzero(possible.any(axis=1))
    if not len(rows):
        return []
    both = _shared([sets[r] for r in rows])
    linked = possible[np.ix_(rows, rows)] & (100 * both >= percent * (size[rows, None] + size[None, rows] - both))
    ids, comps = pdf["cls"].to_numpy()[rows], comps[rows]
    forest, links = _Forest(), []
    for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if forest.join(int(comps[x]), int(comps[y])):
            links.append((int(ids[x]), int(ids[y])))
    return links


def links(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
          k: int = K, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b) links between classes that connect all that are connected: every
    further link lies inside a component. ``classes``: cls, digest, rep (the
    key of a document with that text), n_shingles, sketch."""
    with common.staging() as keep:
        return keep(_links(docs, classes, key, text, width, k, percent, block), "minhash-all-links")


def _links(docs: DataFrame, classes: DataFrame, key: str, text: str, width: int, k: int, percent: int,
           block: int) -> DataFrame:
    lists = common.stage(list_members(classes, k, percent), "minhash-lists")
    hubs = (lists.groupBy("value").agg(F.max_by("cls", F.struct("shared", -F.col("cls"))).alias("hub"),
                                       F.count("*").alias("members")).where("members > 1"))
    pairs = (lists.join(hubs, "value").where("cls != hub")
             .select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct())
    side = classes.select("cls", "n_shingles", "sketch")
    pairs = (pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
             .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                    & (_estimate(F.col("sketch_a"), F.col("sketch_b"), k) >= _cutoff(k, percent)))
             .select("a", "b"))
    pairs = common.stage(pairs, "minhash-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = common.stage(_sets_of(docs, classes, ends, key, text, width), "minhash-hub-sets")
    first = common.stage(_confirm(pairs, sets, percent), "minhash-links")

    # lists of three and more whose members are not yet in one component; of
    # lists with the same members, the first
    comps = components(first)
    labelled = (lists.join(comps.withColumnRenamed("node", "cls"), "cls", "left")
                .select("value", "df", "cls", "earlier", F.coalesce("component", "cls").alias("component")))
    labelled = common.stage(labelled, "minhash-labelled")
    open_lists = (labelled.groupBy("value")
                  .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("df").alias("df"),
                       F.count("*").alias("members"), F.bit_xor(F.xxhash64("cls")).alias("mark"),
                       F.bit_xor(F.hash("cls")).alias("mark2"))
                  .where("low != high and members > 2").groupBy("members", "low", "high", "mark", "mark2")
                  .agg(F.min(F.struct("df", "value")).alias("list")).select("members", F.col("list.value").alias("value")))
    todo = common.stage(labelled.join(open_lists, "value"), "minhash-open")
    sets = common.stage(_sets_of(docs, classes, todo.select("cls").distinct(), key, text, width), "minhash-sets")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(pdf, k, percent), columns=["a", "b"], dtype="int64")

    tiles = _tiles(todo, block)
    rest = tiles.join(sets, "cls").groupBy("value", "kind", "low", "high").applyInPandas(compare, "a long, b long")
    return first.union(rest.distinct())


def _tiles(members: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of a list that have to meet. Members of one component
    need not meet each other, nor do members with the same first key (they met
    in that list): the largest such group of a list, its crowd, meets only the
    others, who meet all."""
    tag = F.struct(F.lit("component").alias("by"), F.col("component").alias("v"))
    met = F.when(F.size("earlier") > 0, F.struct(F.lit("key").alias("by"), F.get("earlier", F.lit(0)).alias("v")))
    tagged = members.withColumn("tags", F.array_compact(F.array(tag, met)))
    crowd = (tagged.select("value", "members", F.explode("tags").alias("tag")).groupBy("value", "members", "tag").count()
             .groupBy("value", "members").agg(F.max(F.struct("count", "tag")).alias("top")))
    half = block / 2
    plan = crowd.select(
        "value", F.col("top.tag").alias("crowd"), F.ceil(F.col("top.count") / half).cast("int").alias("crowd_blocks"),
        F.ceil((F.col("members") - F.col("top.count")) / half).cast("int").alias("other_blocks")).where("other_blocks > 0")
    sided = tagged.join(plan, "value").withColumn("in_crowd", F.array_contains("tags", F.col("crowd")))
    mine = F.pmod(F.xxhash64("cls"), F.when(F.col("in_crowd"), F.col("crowd_blocks")).otherwise(F.col("other_blocks")))

    def tile(kind: str, low, high) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))

    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    crowds = F.sequence(F.lit(0), F.col("crowd_blocks") - 1)
    mine_at = F.col("mine")
    places = F.when(F.col("in_crowd"), F.transform(others, lambda i: tile("crowd", i, mine_at))).otherwise(F.concat(
        F.transform(others, lambda i: tile("others", F.least(i, mine_at), F.greatest(i, mine_at))),
        F.transform(crowds, lambda i: tile("crowd", mine_at, i))))
    return (sided.withColumn("mine", mine.cast("int")).withColumn("place", F.explode(places))
            .select("value", "place.kind", "place.low", "place.high", "cls", "component", "earlier"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K,
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id and kept for every row of ``docs``."""
    with common.staging() as keep:
        return keep(_near_duplicates(docs, key, text, width, k, percent, block), "minhash-result")


def _near_duplicates(docs: DataFrame, key: str, text: str, width: int, k: int, percent: int, block: int) -> DataFrame:
    signed = common.stage(signatures(docs, key, text, width, k), "minhash-signatures")
    named = signed.where(F.col(key).isNotNull() & F.col("digest").isNotNull())
    classes = (named.groupBy("digest").agg(F.min(key).cast("long").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                                           F.first("sketch").alias("sketch"))
               .withColumn("cls", F.monotonically_increasing_id()))
    classes = common.stage(classes, "minhash-classes")  # written once, so the numbers stay
    owners = named.join(classes.select("digest", "cls", "rep"), "digest").select(
        F.col(key).cast("long").alias("id"), "cls", "rep").distinct()
    # a doc_id with several texts ties their classes together
    ties = owners.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b"),
                                    F.collect_set("cls").alias("all")).where("a != b").select(
        "a", F.explode("all").alias("b")).where("a != b")
    found = components(links(docs, classes, key, text, width, k, percent, block).union(ties))
    of_class = (classes.select("cls", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left")
                .select("cls", "rep", F.coalesce("component", "cls").alias("component")))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("cls", "component_id")
    of_id = owners.join(of_class, "cls").groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = signed.select(key, "n_shingles").join(of_id, F.col(key) == F.col("id"), "left")
    component = F.coalesce("component_id", F.col(key).cast("long"))
    return out.select(key, "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col(key), F.lit(True)).alias("kept"))
