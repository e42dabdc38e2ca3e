"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemeter.llm import decontam, langid, licenses, mixing, sharding, simhash, suffix_dedup, tokencount, topk, warc
from prosemeter.llm.common import kept, scratch_path, swept, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    version = F.when(F.coalesce(F.col("page_id"), F.lit(0)) % 2 == 0, 1).otherwise(2)
    records = warc.convert(warc.to_arc(pages, "page_id", "url", "html", version)).where("warc_type <> 'warcinfo'")
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(records), path)
    back = warc.read_warc(spark, path)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_key").alias("refers_to"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with swept(spark):
        return kept(suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "dedup")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, vocabulary_path()).drop("text")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shards.select(
        "doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = mixing.mix(docs.select("doc_id", "source", "lang", "text"))
    return kept.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("tokens"), F.round("__weight", 9).alias("weight"), F.round("__prob", 9).alias("prob"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_license_scan": op4_license_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op4_license_scan": licenses.scan_sql(),
    "op6_suffix_dedup": """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, array_slice(x, p + 1, p + 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100) u),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) t WHERE k > 1),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) t GROUP BY doc_id, run),
e AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS s, list(z ORDER BY a) AS t FROM i GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, coalesce(n_spans, 0) + 1),
    lambda j: hex(array_slice(x, coalesce(CASE WHEN j > 0 THEN t[j] END, 0) + 1, coalesce(s[j + 1], n)))), ''))) AS kept_sha256
FROM b LEFT JOIN e USING (doc_id)
""",
    "op9_mixing": mixing.mix_sql(),
    "op5_exact_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) t WHERE r <= 5
""",
}
