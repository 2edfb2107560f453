"""The registered queries of the dealt operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, ann, bpe, common, html_text, licenses, minhash, packing, prefix_trie, quality, secret_scan,
               substring, token_counts, url_filter)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(common.read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    features = common.stage(quality.add_features(docs, keep=["doc_id", "lang"]), "quality-features")
    judged = quality.judge(features, common.read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(common.read(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    pieces = packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(common.stage(digests, "packing-pieces"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark)).drop("url")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_digests(secret_scan.scan(docs))


def secret_digests(scanned: DataFrame) -> DataFrame:
    base = len(secret_scan.BASE_RULES)
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secret_scan.BASE_RULES]
    base_spans = F.filter("spans", lambda s: s["kind_no"] < base)
    return scanned.select(
        "doc_id", *counts, common.sha_hex(secret_scan.joined_spans(base_spans)).alias("base_sha256"),
        secret_scan.joined_spans(F.col("spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = common.read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("n_repeated_words"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("passages", lambda p: p["first_docs"])))).alias("first_docs"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["begin"], p["stop"])), ",").alias("spans"),
        "text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    aligned = align.align(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digest=True)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                          F.col("groups").alias("groups_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scanned.drop("spans")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    nodes = prefix_trie.trie(common.read(spark, sf_dir, "conversations"), conv - conv % 100,
                             F.crc32(conv.cast("string").cast("binary")) % 6)
    return nodes.drop("digest")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe": op5_bpe,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_text": op10_html_text,
    "op11_token_alignment": op11_token_alignment,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

def _url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return f"""
WITH rules(verdict, rh, rp) AS (VALUES {rules}),
split AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS has,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM split),
pairs AS (SELECT DISTINCT host, path FROM parts),
won AS (
  SELECT host, path, arg_max(rh || rp, length(rh) + length(rp)) AS rule,
         arg_max(verdict, length(rh) + length(rp)) AS verdict
  FROM pairs JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, w.rule, coalesce(w.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN won w ON p.host = w.host AND p.path = w.path"""


ANN_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""


# crc32 by its bitwise definition; sequences and nodes as lists of (role, text).
TRIE_SQL = """
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
held AS (
  SELECT conv_id, s, conv_id - conv_id % 100 AS hub,
    (xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295) % 6)::BIGINT AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s
  FROM held a LEFT JOIN own b ON a.hub = b.conv_id),
prefixes AS (
  SELECT conv_id, s, d::BIGINT AS depth, s[1:d] AS p, len(s) = d AS ends
  FROM rebuilt, unnest(range(0, len(s) + 1)) AS u(d)),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(p[depth].t) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, depth),
kids AS (
  SELECT k.p[1:k.depth - 1] AS p, count(*) AS n_children FROM nodes k WHERE k.depth > 0 GROUP BY 1),
sums AS (
  SELECT n.p[1:d] AS p, sum(n.saved) AS saved_tokens, count(*) FILTER (k.p IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN kids k ON k.p = n.p, unnest(range(0, n.depth + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.p = n.p LEFT JOIN kids k ON k.p = n.p
LEFT JOIN nodes up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]"""


ORACLE_SQL: dict[str, str] = {
    "op3_nearest_neighbours": ANN_SQL,
    "op6_url_filter": _url_sql(),
    "op13_prefix_trie": TRIE_SQL,
}
