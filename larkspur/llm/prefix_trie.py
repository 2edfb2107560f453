"""Prefix trie of conversations by whole-sequence collapse.

1. Turns are dealt out by range of (conversation, turn), so a conversation of
   any length is spread over tasks. Each turn learns its position and the hash
   of all turns up to it: a Horner sum of turn digests modulo a Mersenne prime,
   whose stretches combine, first inside the range, then over the ranges.
2. Every conversation is rebuilt: the first ``h`` turns of a hub conversation,
   then its own from there on. Its prefix hashes follow from those of the two.
3. Identical rebuilt conversations collapse into one weighted sequence with the
   list of conversations that end there; only the sequence with the smallest
   member goes on.
4. Sequences that stand as proper prefix of another are dropped by an anti
   join; the rest are the leaves.
5. The weighted prefixes are aggregated: a (depth, hash) is a node. Sums over a
   subtree come from the sequences through it, without walking the trie: with
   C the characters up to a depth, the members below a node add w * (C_end - C);
   the characters of its distinct nodes are added by the sequences that own
   them, a node being owned by the sequence of its smallest member.

Defined results: null roles and texts are empty; equal turn numbers are ordered
by role, then by digest of the text; repeated rows are turns each; a row
without a conversation number belongs to none and is left out; an empty table
has no nodes, not even a root; other columns are ignored; two prefixes are the
same if their 127-bit hashes are. Very long texts enter as digest and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PRIME = (1 << 127) - 1
# Any fixed number below PRIME that is no small power or root of one.
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
HUB_TURNS = 6       # h is below this
ENDS_CHUNK = 4096   # conversation numbers that one chunk of an end list spans
SALTS = 64          # parts of the children of one node
_ZERO = (0).to_bytes(16, "big")


def _int(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def _bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


def turn_digest() -> Column:
    """16 bytes that tell (role, text) pairs apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, with the digest and length of what was said."""
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        turn_digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    order = ["conv_id", "turn", "role", "digest"]
    # the row number parts a turn that is repeated without end
    dealt = narrow.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row")
    return dealt.sortWithinPartitions(*order, "row").withColumn("part", F.spark_partition_id())


_SCANNED = common.schema("conv_id long, part int, pos long, hash binary, total long, chars long, digest binary")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position, hash and characters up to each turn, inside its range."""
    conv, pos, value, total = None, 0, 0, 0
    for batch in batches:
        ids, chars = common.column(batch, "conv_id"), common.column(batch, "chars")
        digests = common.column(batch, "digest")
        places, hashes, totals = [], [], []
        for c, n, d in zip(ids.to_pylist(), chars.to_pylist(), digests.to_pylist(), strict=True):
            if c != conv:
                conv, pos, value, total = c, 0, 0, 0
            pos += 1
            value = (value * BASE + _int(d) + 1) % PRIME
            total += n
            places.append(pos)
            hashes.append(_bytes(value))
            totals.append(total)
        yield pa.RecordBatch.from_arrays(
            [ids, common.column(batch, "part"), pa.array(places, pa.int64()), pa.array(hashes, pa.binary()),
             pa.array(totals, pa.int64()), chars, digests], names=[f.name for f in _SCANNED.fields])


def positions(conversations: DataFrame) -> DataFrame:
    """Every turn with its position (from 1) in its conversation, the hash of
    the turns up to it and their characters, over all ranges."""
    scanned = common.stage(turns(conversations).mapInArrow(_scan, _SCANNED), "trie-turns")
    spark = scanned.sparkSession
    # Only the first and last conversation of a range go on in another: at most two a range.
    edges = scanned.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"))
    stretches = (scanned.join(F.broadcast(edges), ["part", "conv_id"]).groupBy("conv_id", "part")
                 .agg(F.max("pos").alias("n"), F.max_by("hash", "pos").alias("hash"), F.max("total").alias("total")))
    before, conv = [], None
    for r in sorted(stretches.collect(), key=lambda r: (r.conv_id, r.part)):   # at most two rows a range
        if r.conv_id != conv:
            conv, pos, value, total = r.conv_id, 0, 0, 0
        if pos:
            before.append((r.conv_id, r.part, pos, bytearray(_bytes(value)), total))
        pos, value = pos + r.n, (value * pow(BASE, r.n, PRIME) + _int(r.hash)) % PRIME
        total += r.total
    schema = "conv_id long, part int, pos0 long, hash0 binary, total0 long"
    joined = scanned.join(F.broadcast(spark.createDataFrame(before, schema)), ["conv_id", "part"], "left")
    out = T.StructType([f for f in _SCANNED.fields if f.name != "part"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, hashes, totals = (common.column(batch, n).to_pylist() for n in ("pos", "hash", "total"))
            for i, p in enumerate(common.column(batch, "pos0").to_pylist()):
                if p is not None:
                    value = _int(common.column(batch, "hash0")[i].as_py())
                    hashes[i] = _bytes((value * pow(BASE, pos[i], PRIME) + _int(hashes[i])) % PRIME)
                    pos[i] += p
                    totals[i] += common.column(batch, "total0")[i].as_py()
            done = {"pos": pa.array(pos, pa.int64()), "hash": pa.array(hashes, pa.binary()), "total": pa.array(totals, pa.int64())}
            yield pa.RecordBatch.from_arrays([done[f.name] if f.name in done else common.column(batch, f.name) for f in out.fields],
                                             names=[f.name for f in out.fields])

    return joined.mapInArrow(shift, out)


def rebuilt(placed: DataFrame, hub: Column, taken: Column) -> DataFrame:
    """One row per conversation: ``hub`` is the conversation whose first
    ``taken`` (below HUB_TURNS) turns replace its own first ones. Columns:
    length, hash and total of the whole; from_hub, its hub turns as (hash,
    total, chars, digest); the shift that turns own positions and hashes into
    rebuilt ones."""
    first = F.sort_array(F.collect_list(F.when(
        F.col("pos") < HUB_TURNS, F.struct("pos", "hash", "total", "chars", "digest"))))
    convs = placed.groupBy("conv_id").agg(
        F.max("pos").alias("own"), F.max_by("hash", "pos").alias("own_hash"), F.max("total").alias("own_total"),
        first.alias("first")).withColumn("hub", hub).withColumn("taken", taken)
    hubs = convs.select(F.col("conv_id").alias("hub"), F.col("first").alias("hub_first"))
    joined = convs.join(hubs, "hub", "left").withColumn(
        "from_hub", F.coalesce(F.slice("hub_first", F.lit(1), F.col("taken")), F.array().cast(convs.schema["first"].dataType)))
    return common.with_columns(joined.drop("hub_first"), _WHOLE, _whole,
                               keep=["conv_id", "taken", "from_hub"])


_WHOLE = common.schema("length long, hash binary, total long, shift_pos long, shift_hash binary, shift_total long")


def _whole(batch: pa.RecordBatch) -> list[list]:
    rows = []
    for r in batch.select(["own", "own_hash", "own_total", "first", "from_hub", "taken"]).to_pylist():
        mine = r["first"][r["taken"] - 1] if 0 < r["taken"] <= min(r["own"], len(r["first"])) else None
        hub = r["from_hub"][-1] if r["from_hub"] else {"hash": _ZERO, "total": 0}
        n_hub = len(r["from_hub"])
        left = max(r["own"] - r["taken"], 0)          # own turns that stay
        skipped, skipped_total = (_int(mine["hash"]), mine["total"]) if mine else (0, 0)
        delta = (_int(hub["hash"]) - skipped) % PRIME
        value = (delta * pow(BASE, left, PRIME) + _int(r["own_hash"])) % PRIME if left else _int(hub["hash"])
        total = hub["total"] + (r["own_total"] - skipped_total if left else 0)
        rows.append((n_hub + left, _bytes(value), total, n_hub - r["taken"], _bytes(delta), hub["total"] - skipped_total))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _WHOLE.fields]


def sequences(convs: DataFrame) -> DataFrame:
    """Identical rebuilt conversations as one weighted sequence each."""
    return convs.groupBy("length", "hash").agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.first("total").alias("total"))


def end_lists(convs: DataFrame) -> DataFrame:
    """ends_sha256 of the sorted numbers of the conversations of each sequence.
    Numbers are listed in chunks of a bounded span, sorted in the chunk; a
    stream over the chunks feeds the digest, so no list is held whole."""
    chunks = convs.groupBy("length", "hash", F.floor(F.col("conv_id") / ENDS_CHUNK).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = chunks.repartition("length", "hash").sortWithinPartitions("length", "hash", "chunk").select("length", "hash", "ids")
    out = common.schema("length long, hash binary, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            rows = []
            for length, value, ids in zip(*(common.column(batch, n).to_pylist() for n in ("length", "hash", "ids")), strict=True):
                if (length, value) != at:
                    if state:
                        rows.append((*at, state.hexdigest()))
                    at, state = (length, value), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield _batch(rows, out)
        if state:
            yield _batch([(*at, state.hexdigest())], out)

    return dealt.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), common.arrow_types(schema), strict=True)],
        names=[f.name for f in schema.fields])


_PATH = common.schema(
    "conv_id long, weight long, whole long, depth long, hash binary, parent binary, chars long, total long, digest binary")


def paths(placed: DataFrame, convs: DataFrame, seqs: DataFrame) -> DataFrame:
    """All prefixes, from depth 1, of every sequence: one row per turn of its
    smallest member."""
    chosen = convs.join(seqs.select("conv_id", "weight"), "conv_id")
    hub = chosen.select("conv_id", "weight", F.col("total").alias("whole"), F.posexplode("from_hub").alias("at", "t")).select(
        "conv_id", "weight", "whole", (F.col("at") + 1).cast("long").alias("depth"),
        "t.hash", "t.chars", "t.total", "t.digest",
        F.lit(0).cast("long").alias("power"), F.lit(_ZERO).alias("shift_hash"))
    own = placed.join(chosen.select("conv_id", "weight", F.col("total").alias("whole"), "taken", "shift_pos",
                                    "shift_hash", "shift_total"), "conv_id").where("pos > taken")
    own = own.select("conv_id", "weight", "whole", (F.col("pos") + F.col("shift_pos")).alias("depth"), "hash", "chars",
                     (F.col("total") + F.col("shift_total")).alias("total"), "digest",
                     (F.col("pos") - F.col("taken")).alias("power"), "shift_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, parents = [], []
            for h, p, s, d in zip(*(common.column(batch, n).to_pylist() for n in ("hash", "power", "shift_hash", "digest")), strict=True):
                value = (_int(h) + _int(s) * pow(BASE, p, PRIME)) % PRIME
                hashes.append(_bytes(value))
                parents.append(_bytes((value - _int(d) - 1) * UNBASE % PRIME))
            done = {"hash": pa.array(hashes, pa.binary()), "parent": pa.array(parents, pa.binary())}
            yield pa.RecordBatch.from_arrays([done[f.name] if f.name in done else common.column(batch, f.name) for f in _PATH.fields],
                                             names=[f.name for f in _PATH.fields])

    return hub.unionByName(own).mapInArrow(run, _PATH)


UNBASE = pow(BASE, -1, PRIME)   # takes the last turn off a hash


def trie(conversations: DataFrame, hub: Column | None = None, taken: Column | None = None) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and digest, that of the
    node's last turn (:func:`with_last_turn` gives its words). ``hub`` and
    ``taken`` are expressions of conv_id; without them nothing is rebuilt."""
    hub = F.col("conv_id") if hub is None else hub
    taken = F.lit(0) if taken is None else taken
    placed = common.stage(positions(conversations), "trie-positions")
    convs = common.stage(rebuilt(placed, hub, taken.cast("int")), "trie-conversations")
    seqs = common.stage(sequences(convs), "trie-sequences")
    walked = common.stage(paths(placed, convs, seqs), "trie-paths")

    # the parent of every prefix, the root among them, is a proper prefix of its sequence
    proper = walked.select((F.col("depth") - 1).alias("length"), F.col("parent").alias("hash")).distinct()
    leaves = seqs.join(proper, ["length", "hash"], "left_anti")

    weighted = walked.join(leaves.select("conv_id", F.lit(1).cast("long").alias("leaf")), "conv_id", "left")
    nodes = weighted.groupBy("depth", "hash").agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.first("total").alias("total"),
        F.first("digest").alias("digest"), F.sum(F.col("weight") * (F.col("whole") - F.col("total") + F.col("chars"))).alias("members_chars"))
    root = seqs.join(leaves.select("conv_id", F.lit(1).cast("long").alias("leaf")), "conv_id", "left").agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        F.sum(F.col("weight") * F.col("total")).alias("members_chars")).where("n_convs is not null")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(_ZERO).alias("hash"), "n_convs", "conv_id", "n_leaves",
                       F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"),
                       F.lit(0).cast("long").alias("total"), F.lit(None).cast("binary").alias("digest"), "members_chars")
    nodes = common.stage(nodes.unionByName(root), "trie-nodes")

    owned = nodes.groupBy("conv_id").agg(F.min(F.col("total") - F.col("chars")).alias("owned_from"))
    ends_at = seqs.select("conv_id", F.col("total").alias("whole")).join(owned, "conv_id")
    below = walked.join(owned, "conv_id").groupBy("depth", "hash").agg(
        F.sum(F.col("whole") - F.greatest(F.col("total") - F.col("chars"), "owned_from")).alias("node_chars"))
    root_below = ends_at.agg(F.sum(F.col("whole") - F.col("owned_from")).alias("node_chars")).select(
        F.lit(0).cast("long").alias("depth"), F.lit(_ZERO).alias("hash"), "node_chars")
    sums = nodes.join(below.unionByName(root_below), ["depth", "hash"], "left")

    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    child = nodes.where("depth > 0").select(F.col("depth").alias("child_depth"), F.col("hash").alias("child_hash"),
                                            (F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash"), salt.alias("salt"))
    families = child.groupBy("depth", "hash").agg(F.count("*").alias("n_children"), F.collect_set("salt").alias("salts"))
    named = (nodes.select("depth", "hash", "conv_id").join(families.select("depth", "hash", F.explode("salts").alias("salt")), ["depth", "hash"])
             .join(child, ["depth", "hash", "salt"])
             .select(F.col("child_depth").alias("depth"), F.col("child_hash").alias("hash"), F.col("conv_id").alias("parent_conv_id")))
    ends = end_lists(convs).withColumnRenamed("length", "depth")
    return (sums.join(families.drop("salts"), ["depth", "hash"], "left").join(named, ["depth", "hash"], "left")
            .join(ends, ["depth", "hash"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                    (F.col("members_chars") - F.coalesce("node_chars", F.lit(0))).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "digest"))


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null at the root)."""
    said = conversations.select(turn_digest().alias("digest"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["digest"])
    return nodes.join(said, "digest", "left")
