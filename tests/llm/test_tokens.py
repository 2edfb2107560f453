"""Tokenising operators against the tokenizer libraries, packing, prefixes."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, packing, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=400):
    rng = random.Random(3)
    parts = [*"abcdefghij éüßñçABC,.!?'0123456789", "\n", "\t", "  ", "\x85", " ", "\x1c", "😀", "你好", "'s", "'re",
             "é", " ", "<|endoftext|>", "ا", "İ", "Σ", "ΑΣ", " ", "'ll"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(n)] + [
        "", "a" * 3000, "ab" * 2000, " " * 900 + "x", "they're we'll I've don't !!'s", "<|startoftext|>a b<|endoftext|>",
        "<|x|> a", "plain words on\ntwo lines"]


def test_byte_level_ids_are_those_of_the_library():
    encode, library = packing.byte_level_encoder(BYTE), Tokenizer.from_file(BYTE)
    for t, e in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(t), "<u4").tolist() == e.ids, t


def test_segment_tree_ids_are_those_of_the_library():
    ranks = bpe.load_ranks(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = bpe.encoder(MULTI, public_tokenizers.PATTERN)
    for t in odd_texts():
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode_ordinary(t), t


def test_encode_and_decode_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(60))] + [(None, None), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI).collect()
    assert len(got) == len(rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert [r.ids for r in got if r.text is None] == [[]]
    assert bpe.encode(docs.where("doc_id < 0"), MULTI, public_tokenizers.PATTERN).count() == 0


def test_counts_are_those_of_the_library(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(WORD)
    want = {i: len(e.ids) for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORD).collect()}
    assert got == {**want, -1: 0}


def test_every_prefix_and_budget(spark):
    texts = [t for t in odd_texts(40) if "<|" not in t and len(t) < 200]
    library, words = Tokenizer.from_file(WORD), token_counts.WordTable(WORD)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = {b: {r.doc_id: r for r in token_counts.prefix_counts(docs, WORD, budget=b).collect()} for b in (0, 1, 7)}
    for i, t in enumerate(texts):
        want = [len(e.ids) for e in library.encode_batch([t[:n] for n in range(len(t) + 1)], add_special_tokens=False)]
        table = (rows[1][i].prefix_ends, rows[1][i].prefix_tokens)
        assert [words.count_prefix(t, table, n) for n in range(len(t) + 1)] == want, t
        for budget in rows:
            fit = rows[budget][i].fit_chars
            assert want[fit] <= budget
            if len(words.normalised(t)) == len(t):
                assert fit == max(n for n, c in enumerate(want) if c <= budget), t


@pytest.mark.parametrize("seed,top", [(0, 2048), (1, 600), (2, 64), (3, 30)])
def test_plan_places_every_document_once(seed, top):
    rng = random.Random(seed)
    counts = collections.Counter(min(2048, 1 + int(rng.expovariate(3 / top))) for _ in range(3000))
    counts[2048] += 7
    places, n = packing.plan(dict(counts))
    held, rank = collections.defaultdict(list), collections.Counter()
    for p in places:
        assert p.rank == rank[p.length]
        rank[p.length] += p.count
        for i in range(p.count):
            held[p.sequence + i].append((p.offset, p.length))
    assert rank == counts and set(held) == set(range(n))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(k * v for k, v in counts.items())
    assert n <= 1.01 * total / 2048 + 2


def test_plan_of_nothing():
    assert packing.plan({}) == ([], 0)


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(2049) == [(0, 1), (1, 2048)] and packing.cuts(4096) == [(0, 2048), (2048, 2048)]


def test_pack_keeps_every_id(spark):
    rows = [*enumerate(odd_texts(80)), (900, None), (5, "twin"), (5, "twin"), (None, "no key"), (901, "word " * 9000)]
    rows += [(1000 + i, "same length") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    pieces = packing.tokenise(docs, BYTE).cache()
    packed = packing.pack(pieces).cache()
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, (start, n) in enumerate(packing.cuts(len(ids))):
            want[i, p, start, n, zlib.crc32(ids[start:start + n].tobytes())] += 1
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.c)
                              for r in packed.withColumn("c", F.crc32("ids")).collect())
    assert got == want
    spans = collections.defaultdict(list)
    for r in packed.collect():
        spans[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s, parts in spans.items():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and whole[s].length == end and bytes(whole[s].ids) == b"".join(p[2] for p in sorted(parts))
    assert packing.pack(pieces.where("piece < 0")).count() == 0


def test_round_trip_digests(spark):
    import hashlib
    rows = [(i, t) for i, t in enumerate(odd_texts(60))] + [(None, None), (1, "again")]
    ranks = bpe.load_ranks(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def code_points():
    """Every code point that a text can hold, a few in one text, in three surroundings."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    plain = [c for c in points if ord(c) < 0x20000]
    return ["".join(plain[i:i + 16]) for i in range(0, len(plain), 16)] + [f"a{c}b {c}" for c in plain[:0x3000]] + \
        [f"x{c} {c}'s" for c in plain if 0xA000 <= ord(c) < 0xAC00]


def test_every_code_point():
    texts = code_points()
    byte = packing.byte_level_encoder(BYTE)
    library = Tokenizer.from_file(BYTE)
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(byte(t), "<u4").tolist() == e.ids, ascii(t)
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    encode = bpe.encoder(MULTI, public_tokenizers.PATTERN)
    for t, got in zip(texts, encode.all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == multi.encode_ordinary(t), ascii(t)
    words, table = Tokenizer.from_file(WORD), token_counts.word_table(WORD)
    for t, e in zip(texts, words.encode_batch(texts, add_special_tokens=False), strict=True):
        assert table.count(t) == len(e.ids), ascii(t)
