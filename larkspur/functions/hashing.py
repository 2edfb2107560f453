"""Deterministic, partitioning-independent row hashing for splits and folds.

``randomSplit`` depends on partition layout and ordering; a keyed hash does
not, so the same row lands in the same split on any cluster size and the
assignment is reproducible in plain SQL. The hash is the first 60 bits of
``md5(seed || ':' || key)``: seeds are independent of each other, keys may be
numbers or text, and every SQL engine has it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15
HASH_RANGE = 16 ** HEX_DIGITS   # hashes lie in [0, HASH_RANGE)


def mix_key(key, seed: int | Column = 42) -> Column:
    """Key -> pseudo-random integer in [0, 2^60)."""
    k = F.col(key) if isinstance(key, str) else key
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", s.cast("string"), k.cast("string")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def mix_key_sql(key: str, seed: int | str = 42) -> str:
    """The same hash as SQL text; a text seed is an SQL expression."""
    return f"(('0x' || substr(md5(({seed}) || ':' || ({key})), 1, {HEX_DIGITS}))::BIGINT)"


def bucket(key, modulus: int, seed: int = 42) -> Column:
    """Bucket in [0, modulus)."""
    return F.pmod(mix_key(key, seed), F.lit(modulus))


def bucket_sql(key: str, modulus: int, seed: int = 42) -> str:
    return f"({mix_key_sql(key, seed)} % {modulus})"
