"""Tables of a report: what a test set looks like, and samples worth reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.functions import text as T
from prosemeter.operators import simplification as M
from prosemeter.operators.stats import alignment_shapes, top_k


def description(rows: DataFrame) -> DataFrame:
    """One row: samples, references, words a source and a reference, shares of alignment shapes."""
    t = M.tokenised(rows, lowercase=False)
    pairs = t.select("orig", F.posexplode("refs").alias("ref_id", "ref")).select(
        "ref_id", F.size("orig").alias("ow"), F.size("ref").alias("rw"), T.boundary_sentences(F.col("orig")).alias("os"), T.boundary_sentences(F.col("ref")).alias("rs")
    )
    return pairs.agg(F.sum(F.when(F.col("ref_id") == 0, 1).otherwise(0)).alias("n_samples"), F.countDistinct("ref_id").alias("n_refs"), F.avg("ow").alias("words_source"), F.avg("rw").alias("words_reference"), *alignment_shapes("os", "rs"))


def ranked_samples(rows: DataFrame, keys: list[str], k: int = 50) -> dict[str, DataFrame]:
    """The samples (keys, orig, sys, refs) first in six orders: as they come, best and worst SARI,
    strongest compression, most paraphrase (edit similarity over compression), most splits."""
    scores = M.sari(M.tokenised(rows), keys, keys).select(*keys, "sari")
    q = M.quality_features(rows).join(scores, keys)
    paraphrase = F.when(F.col("compression") > 0, F.col("edit_similarity") / F.col("compression")).otherwise(0.0)
    orders = {
        "as they come": F.col(keys[0]).asc(), "best SARI": F.desc("sari"), "worst SARI": F.asc("sari"),
        "strongest compression": F.asc("compression"), "most paraphrase": paraphrase.asc(), "most splits": F.desc("splits"),
    }
    return {name: top_k(q, order, keys, k) for name, order in orders.items()}
