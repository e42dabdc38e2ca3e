"""Row neighbourhoods: runs of equal values, and what stands around a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, run, n, first, last): maximal runs of neighbouring rows with an equal value.

    Nulls are a value of their own. `first` and `last` are of the first order column.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return numbered.groupBy(*keys, value, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def neighbours(words: Column, radius: int = 3) -> Column:
    """For each word of an array, the words up to `radius` before and after it, without itself."""
    around = lambda i: F.concat(F.slice(words, F.greatest(i - radius + 1, F.lit(1)), i - F.greatest(i - radius, F.lit(0))), F.slice(words, i + 2, radius))
    return F.transform(words, lambda _, i: around(i))
