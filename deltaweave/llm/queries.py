"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, decontamination, extraction, mixing, neighbours, quality, variants
from ._store import Scratch, table
from .negatives import hard_negatives
from .runindex import remove_repeated_bytes
from .sharding import shard_documents
from .simhash import near_duplicates
from .substring import remove_repeats
from .suffix_tree import score_documents


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    archives.write_arc(table(spark, sf_dir, "pages"), scratch.path("arc"))
    archives.convert(spark, scratch.path("arc"), scratch.path("warc"))
    scratch.drop("arc")
    return archives.read_warc(spark, scratch.path("warc"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.counted(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_simhash": op2_simhash,
    "op3_extraction": op3_extraction,
    "op4_quality": op4_quality,
    "op5_archives": op5_archives,
    "op6_sharding": op6_sharding,
    "op7_voronoi": op7_voronoi,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_substring": op10_substring,
    "op11_negatives": op11_negatives,
    "op12_runindex": op12_runindex,
    "op13_variants": op13_variants,
}

ARCHIVES_ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS NOT NULL THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS kept FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""

VORONOI_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

SUBSTRING_ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) q),
st AS (SELECT rid, i FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) r USING (s)),
words AS (SELECT rid, w[j] AS word, j FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS j FROM d) q),
cov AS (SELECT rid, j, word, coalesce(max(i) OVER (PARTITION BY rid ORDER BY j ROWS UNBOUNDED PRECEDING) >= j - 34, FALSE) AS gone FROM (SELECT words.rid, words.j, words.word, st.i FROM words LEFT JOIN st ON st.rid = words.rid AND st.i = words.j) q),
kept AS (SELECT rid, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS t FROM cov GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

NEGATIVES_ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

RUNINDEX_ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, rid, i, substr(x, 2 * i + 1, 200) AS w FROM (SELECT doc_id, rid, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200) q),
st AS (SELECT rid, i FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
runs AS (SELECT rid, min(i) AS s, max(i) + 100 AS e FROM (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM (
    SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM st) q) q GROUP BY rid, k),
gaps AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM runs),
cut AS (SELECT rid, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""

ORACLES: dict[str, str] = {
    "op11_negatives": NEGATIVES_ORACLE,
    "op12_runindex": RUNINDEX_ORACLE,
    "op10_substring": SUBSTRING_ORACLE,
    "op5_archives": ARCHIVES_ORACLE,
    "op7_voronoi": VORONOI_ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
