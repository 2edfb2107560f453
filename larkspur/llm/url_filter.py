"""URL rules behind a blocked Bloom filter, DataFrame functions only.

A rule is a canonical (host, path prefix) with a verdict; it fits a URL whose
host is the rule's or a subdomain and whose path starts with the rule's path.
The canonical keys of all rules go into a blocked Bloom filter (one 64-bit
block per key, BITS bits in it). A URL's possible keys, every host suffix with
every prefix length that some rule has, are tested against the filter in the
row; only possible hits leave it, are made distinct, and meet the rules in an
exact hash join, which removes the filter's false positives.

The longest rule wins (host and path together; then the longer host; of equal
rules a block wins). Without a rule the verdict is "allow": the list names
what is blocked.

Defined results: a null URL or one without "://" has an empty host and path
and fits no rule; repeated rows are judged alike; no rules allow everything;
other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 4                  # bits that a key sets in its block
BITS_PER_RULE = 16
MAX_BLOCKS = 1 << 16      # 512 KB: beyond it false positives grow, results do not change
DEFAULT = "allow"

# The rules of the result contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased, the path without query and fragment."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """BITS bits of a 64-bit block from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_filter(rules: DataFrame) -> tuple[Column, int]:
    """The filter as a constant array of blocks (at most MAX_BLOCKS), and their number."""
    wanted = rules.count() * BITS_PER_RULE // 64
    blocks = 1 << max(4, min(MAX_BLOCKS, max(1, wanted)).bit_length())
    blocks = min(blocks, MAX_BLOCKS)
    key = _key(F.col("rule_host"), F.col("rule_path"))
    filled = (rules.select(_block(key, blocks).alias("block"), _mask(key).alias("mask"))
              .groupBy("block").agg(F.bit_or("mask").alias("mask")).collect())  # at most MAX_BLOCKS rows
    words = [0] * blocks
    for r in filled:
        words[r["block"]] = r["mask"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>"), blocks


def _suffixes(host: Column, depths: list[int]) -> Column:
    """The domains above the host, and the host, that have as many labels as
    some rule: a few, however many labels the host has."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -d) for d in depths]))


def possible_keys(host: Column, path: Column, lengths: list[int], depths: list[int], bloom: Column, blocks: int) -> Column:
    """Structs (host, path) of the keys that pass the filter."""
    prefixes = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])))
    keys = F.flatten(F.transform(_suffixes(host, depths), lambda h: F.transform(prefixes, lambda p: F.struct(
        h.alias("host"), p.alias("path")))))

    def passes(k: Column) -> Column:
        key = _key(k["host"], k["path"])
        mask = _mask(key)
        return F.get(bloom, _block(key, blocks)).bitwiseAND(mask) == mask

    return F.filter(keys, passes)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule ("host/path" of the winner, else null),
    and verdict."""
    added = ("host", "path", "rule", "verdict")
    host, path = canonical(F.col(url))
    named = pages.drop(*[c for c in added if c != url]).withColumns({"_host": host, "_path": path})
    best = (rules.dropna().groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")))  # block > allow
    lengths = sorted(r["n"] for r in best.select(F.length("rule_path").alias("n")).distinct().collect())
    depths = sorted(r["n"] for r in best.select(F.size(F.split("rule_host", r"\.", -1)).alias("n")).distinct().collect())
    if not lengths:
        found = named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(DEFAULT)})
    else:
        bloom, blocks = bloom_filter(best)
        # a URL's rule depends on its host and path alone: judge each pair once
        pairs = named.where("_host != ''").select("_host", "_path").distinct()
        # explode_outer: for explode the optimizer would evaluate the keys once more, as a filter
        possible = pairs.select("_host", "_path", F.explode_outer(possible_keys(
            F.col("_host"), F.col("_path"), lengths, depths, bloom, blocks)).alias("k")).where("k IS NOT NULL")
        hits = possible.join(best, (F.col("k.host") == F.col("rule_host")) & (F.col("k.path") == F.col("rule_path")))
        winner = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"),
                                F.length("rule_host").alias("h"), "rule_host", "rule_path", "verdict"))
        won = hits.groupBy("_host", "_path").agg(winner.alias("w")).select(
            "_host", "_path", F.concat("w.rule_host", "w.rule_path").alias("rule"), F.col("w.verdict").alias("verdict"))
        found = named.join(won, ["_host", "_path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))
    kept = [c for c in pages.columns if c not in added or c == url]
    return found.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict")
