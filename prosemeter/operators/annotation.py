"""Edit-operation analysis from labels, and sentence labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemeter.functions.words import edit_operations

LABELS = ("D", "R", "M", "C", "A")


def annotate(pairs: DataFrame, source: str = "orig", target: str = "sys") -> DataFrame:
    """Adds labels (source, target) of two token columns."""
    return pairs.withColumn("labels", edit_operations(F.col(source), F.col(target)))


def sentence_labels(labels: Column, split_ratio: Column, clauses: bool = False) -> Column:
    """The distinct word labels, and S where the output has more sentences than the source."""
    every = F.concat(labels["source"], labels["target"], F.when(split_ratio > 1, F.array(F.lit("S"))).otherwise(F.array().cast("array<string>")))
    if not clauses:
        every = F.transform(every, lambda x: F.when(F.upper(x).isin("DC", "AC", "MC"), F.substring(F.upper(x), 1, 1)).otherwise(x))
    return F.array_sort(F.array_distinct(every))


def plain_label(label: Column) -> Column:
    """What follows the prefix of a begin/inside label."""
    return F.element_at(F.split(label, "-"), -1)


def operation_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(label, f1): a row's token-level F1 of automatic labels `auto` against each of the label
    arrays in `refs`, the best of them, averaged over rows."""
    at = rows.select(*keys, "auto", F.posexplode("refs").alias("ref_id", "ref")).select(*keys, "ref_id", F.inline(F.arrays_zip(F.col("auto").alias("x"), F.col("ref").alias("y"))))
    hit = lambda t: F.sum(F.when(t, 1).otherwise(0))
    long = at.select("*", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    sums = long.groupBy(*keys, "ref_id", "label").agg(hit((F.col("x") == F.col("label")) & (F.col("y") == F.col("label"))).alias("c"), hit(F.col("x") == F.col("label")).alias("a"), hit(F.col("y") == F.col("label")).alias("r"))
    f1 = F.when(F.col("a") + F.col("r") > 0, 2 * F.col("c") / (F.col("a") + F.col("r"))).otherwise(0.0)
    best = sums.groupBy(*keys, "label").agg(F.max(f1).alias("f1"))
    return best.groupBy("label").agg(F.avg("f1").alias("f1"))
