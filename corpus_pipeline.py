"""Documents to a training corpus: each stage calls one operator of prosemeter.llm.

Every stage works on all that its predecessor kept, returns the columns of `documents`
(the last adds size, shard and slot) and is written as Parquet before the next reads it.
Null doc_ids, texts, languages and sources pass through the stages as the operators say;
an empty table gives an empty corpus. Further columns of `documents` travel with their rows,
but for ones named size, shard or slot, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemeter.llm import decontam, langid, mixing, sharding, simhash_texts
from prosemeter.llm.common import cut, kept_at, remove, swept, table

#: Below this corrected hit rate per n-gram a text is in none of the learned languages.
LEAST_HIT_RATE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in none of the learned languages."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    judged = langid.predict(docs, model, prefix="__")
    known = (F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__hit_rate") >= LEAST_HIT_RATE)
    return judged.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts with five-word similarity 0.8 or more: the one with the smallest
    doc_id (null last), of rows that repeat it the one with the smallest hash of its text.
    """
    marked = docs.withColumn("__node", F.xxhash64("text"))
    near = cut(simhash_texts.similar_texts(docs), "near").withColumnRenamed("node", "__node")
    rows = marked.select("doc_id", "__node").join(near, "__node", "left").withColumn("component", F.coalesce("component", "__node"))
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__node")).alias("m"))
    first = least.select(F.col("m.doc_id").alias("__first"), F.col("m.__node").alias("__text"))
    kept = marked.join(first, F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("__node") == F.col("__text")), "left_semi")
    order = Window.partitionBy("doc_id", "__node").orderBy(*(F.col(c) for c in ("lang", "source", "text") if c in docs.columns))
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Fitting, fingerprints and the seeded shuffle are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with swept(spark):  # what the stage wrote for itself goes, its result stays
            docs, path = kept_at(stage(spark, docs, sf_dir), name)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
