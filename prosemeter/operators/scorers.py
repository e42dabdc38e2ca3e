"""Pluggable scorers: anything that maps a batch of texts to numbers.

A scorer is made once a worker and then called a batch at a time. Models that are not at hand
(perplexity, metaphor, sentiment) come in here; the fallbacks are marked as such and their
values are not those of the models they stand in for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[float]]
FAILED = -1.0


def scorer_column(make: Callable[[], Scorer], failed: float = FAILED) -> Callable[[Column], Column]:
    """A column function from a scorer factory; a text that fails scores `failed`."""

    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = make()
        for texts in it:
            batch = [t or "" for t in texts]
            try:
                yield pd.Series(score(batch), dtype="float64")
            except Exception:  # the batch again, a text at a time: one bad text costs its own score only
                yield pd.Series([_one(score, t, failed) for t in batch], dtype="float64")

    return run


def _one(score: Scorer, text: str, failed: float) -> float:
    try:
        return float(score([text])[0])
    except Exception:
        return failed


def unigram_perplexity(counts: dict[str, int], cap: int | None = None) -> Callable[[], Scorer]:
    """Fallback language model: add-one unigrams; perplexity over all words, or the first `cap` as a model of that
    context has it; 1000 without one."""
    total, kinds = sum(counts.values()), len(counts) + 1

    def make() -> Scorer:
        def score(texts: list[str]) -> list[float]:
            out = []
            for t in texts:
                ws = t.lower().split()[:cap]
                nll = sum(-math.log((counts.get(w, 0) + 1) / (total + kinds)) for w in ws)
                out.append(math.exp(nll / (len(ws) + 1e-9)) if ws else 1000.0)
            return out

        return score

    return make


def word_counts(docs: DataFrame, text: str, most: int = 1_000_000) -> dict[str, int]:
    """Counts of all words for the fallback model, which workers hold; over `most` distinct words
    (a memory bound, some 100 MB) it raises: `unigram_perplexity_of` joins counts instead."""
    w = docs.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("w")).where("w <> ''").groupBy("w").count()
    got = Counter(dict(w.limit(most + 1).toLocalIterator()))
    if len(got) > most:
        raise ValueError(f"more than {most} distinct words")
    return got


def unigram_perplexity_of(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, perplexity) by the counts of all words of `docs`, add-one, joined and not collected:
    what is counted grows with the input. Texts without a word score 1000.

    Words are summed by document before they meet their counts.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    own = docs.select(*keys, F.explode_outer(words).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    counts = own.where("w is not null").groupBy("w").agg(F.sum("c").alias("n"))
    whole = counts.agg((F.sum("n") + F.count("*") + 1).alias("whole"))  # a single row
    scored = own.join(counts, "w", "left").withColumn("nll", -F.col("c") * F.log(F.col("n") + 1))
    sums = scored.groupBy(*keys).agg(F.sum("nll").alias("s"), F.sum(F.when(F.col("w").isNotNull(), F.col("c"))).alias("m"))
    mean = (F.col("s") + F.col("m") * F.log("whole")) / (F.col("m") + 1e-9)
    return sums.join(F.broadcast(whole)).select(*keys, F.when(F.col("m") > 0, F.exp(mean)).otherwise(1000.0).alias("perplexity"))
