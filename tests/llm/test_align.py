"""Token alignment against the libraries and plain byte ranges."""

import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm import align, packing, queries

from .test_tokens import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    byte = packing.byte_alphabet()
    entry = {i: t for t, i in lib_a.get_vocab().items()}

    def piece(i):
        p = lib_b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for t in texts:
        groups, links = [], []
        if t:
            a = [(i, bytes(byte[c] for c in entry[i])) for i in lib_a.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in lib_b.encode(t)]
            raw = (" " + t).encode()
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                spans = []
                for tokens in (a, b):
                    at, out = 0, []
                    for i, x in tokens:
                        out.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(out)
                cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                low, j = 0, 0
                for cut in cuts:
                    groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= cut) for side in spans)) if len(raw) < 4000 else None
                    low = cut
                for s, e, i in spans[0]:
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(spans[1]) and spans[1][k][0] < e:
                        links.append((i, spans[1][k][2]))
                        k += 1
                docs.append((len(a), len(b), len(cuts), links, ";".join(groups)))
                continue
        docs.append((0, 0, 0, [], ""))
    count = collections.Counter(p for d in docs for p in set(d[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(d[0], d[1], d[2], len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


def texts():
    rng = random.Random(9)
    words = ["the", "naïve", "résumé", "tokenization", "Größe", "2024", "don't", "x_y", "😀😀", "你好吗", "\n", "", "▁", "a\tb", "\x00", "​", "’s"]
    out = [" ".join(rng.choices(words[:-5] if rng.random() < 0.7 else words, k=rng.randint(1, 40))) for _ in range(150)]
    return out + odd_texts(150) + ["", None, " ", "  ", "<|endoftext|> <s> </s> <unk> <0x41>", "a ▁b", "same", "same", "\n\n a \n b\r\n", "é" * 700]


def test_against_the_libraries(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_LINKS", 500)
    all_texts = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(all_texts)], "doc_id long, text string, n_best string").repartition(3)
    want = brute(all_texts)
    got = align.align(docs, A, B, keep=["doc_id", "n_best"])
    assert got.columns.count("n_best") == 1
    rows = got.collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6], all_texts[r.doc_id]
        if len(all_texts[r.doc_id] or "") < 600:
            assert r.groups == w[6], all_texts[r.doc_id]
    assert align.align(docs.where("doc_id < 0"), A, B, keep=["doc_id"]).count() == 0


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(align, "CACHE_LIMIT", 40)
    monkeypatch.setattr(align, "LONGEST_KEPT", 3)
    work = align.Aligner(A, B)
    for t in texts():
        fresh = align.Aligner(A, B) if t in ("same", "a ▁b", " ") else None
        got = work.tokenise([t or "", "again"])
        numbers, ends = work.align(got)
        assert ends[-1] == len(numbers) and got.ends_a[-1] == len(got.a) and got.ends_b[-1] == len(got.b)
        windows = work.windows
        groups = b";".join(windows.groups[n] for n in numbers)
        assert groups.count(b"|") == windows.n_groups[numbers].sum()
        links, upto = windows.links_of(numbers)
        assert len(links) == upto[-1] == len(got.a) + len(got.b) - windows.n_groups[numbers].sum()
        if fresh:
            assert fresh.tokenise([t or "", "again"]).a.tolist() == got.a.tolist()
        assert len(windows.known) <= 40 + len(numbers) and len(work.chunk_no) <= 40 + len(numbers)
        windows.bound_pairs()


def test_query_on_a_folder(spark, tmp_path):
    some = texts()[:80] + [None, "", "a ▁b"]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == COLUMNS
    want = brute(some)
    for r in got.collect():
        w = want[r.doc_id]
        assert tuple(r)[1:7] == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
