"""Prefix trie against a walk over plain dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text) without ties of different turns."""
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            convs.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in m if whole[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m),
                    sum(len(q) == len(p) + 1 for q in below),
                    sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(420), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, t, role, rng.choice(["a", "bb", "ccc", "é😀", "", None]) if rng.random() < 0.9 else f"x{c}"))
    return rows


def check(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = F.col("conv_id")
    nodes = prefix_trie.trie(table, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
    assert sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=str) == brute(rows)
    return table, nodes


def test_against_brute_force(spark):
    rows = planted(1)
    table, nodes = check(spark, rows)
    said = prefix_trie.with_last_turn(nodes, table).collect()
    assert len(said) == nodes.count()
    assert all((r.role is None) == (r.depth == 0) for r in said)


def test_one_long_conversation_and_copies(spark):
    """A conversation that spans several ranges, one that holds no turns after
    rebuilding, many equal ones, null turns, rows without a conversation."""
    rows = planted(2, 60)
    rows += [(1000, t, "user", f"t{t % 7}") for t in range(130)]
    rows += [(1001, t, "user", f"t{t % 7}") for t in range(110)]
    rows += [(c, t, "user", "same") for c in range(2000, 2040) for t in range(2)]
    rows += [(3001, None, "user", "first"), (3001, 0, "user", "second"), (3001, -1, "user", "between"), (None, 0, "user", "lost")]
    check(spark, rows)


def test_empty_and_clashing(spark):
    schema = "conv_id long, turn long, role string, text string, digest string, depth string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    table = spark.createDataFrame([(1, 0, None, "x" * 100_000, "d", "e"), (1, 0, None, "x" * 100_000, "d", "e")], schema)
    got = sorted((tuple(r) for r in prefix_trie.trie(table).select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens").collect()))
    assert got == [(1, 0, 1, 1, 0), (1, 1, 1, 1, 0), (1, 2, 1, 1, 0)]


def test_query_on_a_folder(spark, tmp_path):
    rows = planted(3, 40)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_hash_of_stretches_combines(n):
    digests = [hashlib.md5(str(i).encode()).digest() for i in range(8)]

    def run(part):
        value = 0
        for d in part:
            value = (value * prefix_trie.BASE + int.from_bytes(d, "big") + 1) % prefix_trie.PRIME
        return value

    left, right = run(digests[:n]), run(digests[n:])
    assert (left * pow(prefix_trie.BASE, 8 - n, prefix_trie.PRIME) + right) % prefix_trie.PRIME == run(digests)
