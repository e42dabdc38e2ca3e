"""The whole evaluation of a set of records: scores, output records and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.functions import buckets as B
from prosemeter.operators import documents as D
from prosemeter.operators import nested as N
from prosemeter.operators.stats import metric_statistics

#: Metric -> whether negative values are failures. Vividness and its parts keep theirs.
METRICS = {
    "simplicity_fkgl_score": True, "coherence_ppl_score": True, "coherence_llm_score": True, "vividness_score": False, "figurativeness": False,
    "emotionality": False, "decorativeness": False, "keyfacts_precision": True, "keyfacts_recall": True, "informativeness_score": True,
}


def evaluate(records: DataFrame, text: str = "text", skip: frozenset[str] = frozenset(), perplexity=None, figurativeness=None, emotionality=None) -> DataFrame:
    """Records (doc_id, .., text) with their scores, in the fields of an output record.

    perplexity, figurativeness, emotionality: column functions of a text (scorers), or None. `skip`
    names components (simplicity, coherence, vividness) to leave out. Blank texts score -1, in
    vividness 0; they stay in the result.
    """
    out = records
    empty = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    none = F.lit(None).cast("double")
    if "simplicity" not in skip:
        out = D.readability(out, text).withColumnsRenamed({"fkgl": "simplicity_fkgl_score", "fkgl_label": "simplicity_interpretation"}).drop("n_sentences", "n_words", "n_syllables")
    if "coherence" not in skip:
        ppl = F.when(empty, -1.0).otherwise(perplexity(F.col(text))) if perplexity else none
        out = out.withColumn("coherence_ppl_score", ppl)
        out = out.withColumn("coherence_interpretation", F.when(F.col("coherence_ppl_score").isNotNull(), B.ppl_label(F.col("coherence_ppl_score"))))
    if "vividness" not in skip:
        out = D.decorativeness(out, text).drop("n_tokens", "n_adjectives", "n_adverbs", "n_decorative_distinct")
        for name, f in (("figurativeness", figurativeness), ("emotionality", emotionality)):
            out = out.withColumn(name, F.when(empty, 0.0).otherwise(f(F.col(text))) if f else F.lit(0.0))
        out = out.withColumn("vividness_score", B.vividness(F.col("figurativeness"), F.col("emotionality"), F.col("decorativeness")))
    return out


PRIORITIES = (1, 2, 3)


def assemble(scored: DataFrame, keys: list[str], facts: DataFrame | None = None, quiz: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """Scored records with what came back from the judges; each part is optional and each record stays.

    facts: (keys, priority, precision, recall), priority 0 being all, as the key-fact operators give
    them; quiz: (keys, questions, answers); replies: (keys, reply), several a record. Records without
    an answer have nulls, which the statistics leave out.
    """
    out = scored
    if facts is not None:
        pick = lambda c, p: F.max(F.when(F.col("priority") == p, F.col(c)))
        entries = lambda c: F.filter(F.array(*(F.struct(F.lit(f"priority_{p}").alias("key"), pick(c, p).alias("value")) for p in PRIORITIES)), lambda e: e["value"].isNotNull())
        wide = facts.groupBy(*keys).agg(*(x for c in ("precision", "recall") for x in (pick(c, 0).alias(f"keyfacts_{c}"), F.map_from_entries(entries(c)).alias(f"keyfacts_{c}_by_priority"))))
        out = out.join(wide, keys, "left")
    if quiz is not None:
        out = out.join(quiz.select(*keys, N.mcq_accuracy(F.col("questions"), F.col("answers")).alias("informativeness_score")), keys, "left")
    if replies is not None:
        out = out.join(N.judged(replies, keys).select(*keys, F.col("score").alias("coherence_llm_score")), keys, "left")
    return out


def output_records(scored: DataFrame, text: str = "text") -> DataFrame:
    """Without the texts, and with nulls for what is empty."""
    return N.drop_empty(scored.drop(text))


def statistics(scored: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, metric, mean, min, max, count) of every metric that has valid scores, key facts by priority too."""
    by_priority = [(f"keyfacts_{c}_by_priority", f"priority_{p}") for c in ("precision", "recall") for p in PRIORITIES]
    wide = scored.withColumns({f"{c}.{k}": F.try_element_at(c, F.lit(k)) for c, k in by_priority if c in scored.columns})
    plain = wide.withColumnsRenamed({c: c.replace(".", "__") for c in wide.columns if "." in c})
    found = metric_statistics(plain, {m: v for m, v in (METRICS | {f"{c}__{k}": True for c, k in by_priority}).items() if m in plain.columns}, by)
    return found.withColumn("metric", F.replace("metric", F.lit("__"), F.lit(".")))
