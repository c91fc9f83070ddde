"""Registered queries of the operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, chunk_dedup, decontaminate, licenses, minhash, packing, prefix_free, prefix_trie, quality_model, quality_rules,
    secret_scan, shards, toxicity,
)

QUALITY_THRESHOLD = 0.7
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def quality_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, similarity_percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.train(docs, quality_training(spark, sf_dir))
    scored = quality_model.quality_scores(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path())
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.in_sequences(digests)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(_table(spark, sf_dir, "documents")).drop("tag")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, chain).filter("flagged").drop("flagged")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.kd_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return alignment.alignment(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free.without_repeated_strings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_quality_rules, op3_quality_model, op4_decontaminate, op5_license_scan,
        op6_packing, op7_substring_dedup, op8_toxicity, op9_secret_scan, op10_sharding,
        op11_tokenizer_alignment, op12_suffix_dedup, op13_prefix_trie,
    )
}

_WORDS = r"[x FOR x IN string_split_regex({text}, '[\x20\x09-\x0D]+') IF x <> '']"

ORACLES = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS gs
  FROM lowered
), grams AS (SELECT doc_id, unnest(gs) AS g FROM shingled),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN shingled x ON x.doc_id = a JOIN shingled y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.gs) + len(y.gs) - n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.gs) AS BIGINT) AS n_shingles, r.least AS component_id, s.doc_id = r.least AS kept
FROM shingled s JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) r ON r.doc_id = s.doc_id
""",
    "op2_quality_rules": rf"""
WITH split_up AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS ws,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents
), places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM split_up WHERE len(ws) >= 5),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (
  SELECT doc_id, sum(least(5, gap)) AS n
  FROM (SELECT doc_id, i - lag(i, 1, i - 5) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM twice) GROUP BY 1
), counted AS (
  SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split_up s LEFT JOIN repeats r ON r.doc_id = s.doc_id
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * word_chars BETWEEN 25 * n_words AND 140 * n_words AND 10 * n_symbols <= 3 * n_words
  AND 10 * n_dup_lines <= 3 * n_lines AND 2 * n_capitals <= word_chars AS kept
FROM judged
""",
    "op13_prefix_trie": """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)),
      lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)
), turns AS (
  SELECT v.c, o.d, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 5 AND o.d <= v.h
  UNION ALL SELECT v.c, o.d, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.d > v.h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY d) AS d, sha256(length(role)::VARCHAR || ' ' || role || text) AS turn, strlen(text) AS size
  FROM turns
), places AS (
  SELECT c, d, size, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS path FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM convs
), lengths AS (SELECT c, max(d) AS n FROM places GROUP BY c),
nodes AS (
  SELECT p.path, any_value(p.d) AS depth, any_value(p.size) AS size, min(p.c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (l.n = p.d), '') AS ends
  FROM places p JOIN lengths l ON l.c = p.c GROUP BY p.path
), above AS (SELECT path, left(path, 64 * (depth - 1)::BIGINT) AS parent FROM nodes WHERE depth > 0),
kids AS (SELECT parent AS path, count(*) AS n FROM above GROUP BY 1),
sums AS (
  SELECT a.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM nodes n LEFT JOIN kids k ON k.path = n.path JOIN places a ON a.c = n.conv_id AND a.d <= n.depth GROUP BY a.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN kids k ON k.path = n.path
LEFT JOIN above a ON a.path = n.path LEFT JOIN nodes p ON p.path = a.parent
""",
}
