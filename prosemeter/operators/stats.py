"""Aggregates over scores: statistics, bins, histograms, classification figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemeter.functions import text as T


def metric_statistics(scores: DataFrame, metrics: dict[str, bool], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, metric, mean, min, max, count) in one pass; metrics: name -> whether negatives are
    failures to leave out. Metrics without a valid score do not appear."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col(m) >= 0, F.col(m)).otherwise(None if drop else F.col(m)).cast("double").alias("value")) for m, drop in metrics.items()))
    long = scores.select(*by, F.inline(rows)).where("value is not null")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))


def study_statistics(scores: DataFrame, value: str, by: list[str], low: float = 0, high: float = 10_000) -> DataFrame:
    """(by, mean, median, std, min, max, n) of scores inside (low, high); the upper median and the
    population deviation."""
    valid = scores.where((F.col(value) > low) & (F.col(value) < high)).select(*by, F.col(value).cast("double").alias("v"))
    # the approximate quantiles bracket the middle (their error is a tenth of the margin), so that only
    # the bracket's distinct values are put in order, not a group's rows
    ends = F.percentile_approx("v", [0.499, 0.501], F.lit(10_000))
    sums = valid.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n"), ends.alias("__ends"))
    joined = valid.join(sums.select(*by, "n", "__ends"), by)
    spot = F.when(F.col("v") < F.col("__ends")[0], F.lit(None)).otherwise(F.col("v"))
    counts = joined.where(F.col("v") <= F.col("__ends")[1]).groupBy(*by, "n", spot.alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("v")))
    middle = counts.withColumn("__upto", upto).where((F.col("__upto") > F.floor(F.col("n") / 2)) & (F.col("__upto") - F.col("c") <= F.floor(F.col("n") / 2)))
    return sums.join(middle.select(*by, F.col("v").alias("median")), by).select(*by, "mean", "median", "std", "min", "max", "n")


def first_rows(rows: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows by `order`; all without an n or for 0 and less."""
    return rows.orderBy(*order).limit(n) if n and n > 0 else rows


def at_indices(rows: DataFrame, index: str, chosen: list[int] | None) -> DataFrame:
    """Rows whose index is among those chosen; all for None."""
    return rows if chosen is None else rows.where(F.col(index).isin(chosen) if chosen else F.lit(False))


def perplexity_study(texts: DataFrame, score: str, text: str, by: list[str], order: list[str], first: int | None = 20, least: int = 50) -> DataFrame:
    """(by, mean, median, std, min, max, n): of each group's first texts by `order` (a feature of the
    study; None for all), those of `least` characters without outer blanks, with scores inside (0, 10000)."""
    ranked = texts.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= first) if first else texts
    return study_statistics(ranked.where(F.length(T.strip(F.col(text))) >= least), score, by)


def binary_figures(labels: DataFrame, truth: str, guess: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, accuracy, precision, recall, f1) of 0/1 columns."""
    hit = lambda test: F.sum(F.when(test, 1).otherwise(0))
    t, g = F.col(truth), F.col(guess)
    sums = labels.where(t.isNotNull() & g.isNotNull()).groupBy(*by).agg(hit((t == 1) & (g == 1)).alias("tp"), hit((t == 0) & (g == 1)).alias("fp"), hit((t == 1) & (g == 0)).alias("fn"), F.avg(F.when(t == g, 1.0).otherwise(0.0)).alias("accuracy"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(F.col("tp"), F.col("tp") + F.col("fp")), zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, "accuracy", p.alias("precision"), r.alias("recall"), zero(2 * p * r, p + r).alias("f1"))


def fold_means(figures: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std) over folds."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))
    return figures.select(F.inline(rows)).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def length_limits(rows: DataFrame, length: Column, bins: int = 5) -> DataFrame:
    """(bin, low, high): half-open intervals of about equally many rows, by length.

    Edges come from the counts of distinct lengths, few in number, not from a sort of the rows.
    """
    hist = rows.groupBy(length.alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(1)).orderBy("len")
    cum = hist.withColumns({"upto": F.sum("c").over(w), "total": F.sum("c").over(Window.partitionBy(F.lit(1))), "top": F.max("len").over(Window.partitionBy(F.lit(1)))})
    picks = cum.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("at", F.col("bin") * F.floor(F.col("total") / bins))
    lows = picks.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select("bin", F.col("len").alias("low"), "top")
    return lows.select("bin", "low", F.coalesce(F.lead("low").over(Window.partitionBy(F.lit(1)).orderBy("bin")), F.col("top") + 1).alias("high"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int = 100, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, bin, n): equal-width bins from 1; 0 and bins + 1 take what lies outside."""
    return rows.groupBy(*by, F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, key: Column, tie: list[str], k: int = 50) -> DataFrame:
    """The first k rows by key, ties by row id (a top-k, not a sort of all rows)."""
    return rows.orderBy(key, *tie).limit(k)


def alignment_shapes(orig_sentences: str, ref_sentences: str) -> list[Column]:
    """Aggregates: shares of 1-1, 1-N, N-N and N-1 among (source, reference) pairs, in percent."""
    o, r = F.greatest(F.col(orig_sentences), F.lit(1)) > 1, F.greatest(F.col(ref_sentences), F.lit(1)) > 1
    share = lambda test: F.round(100 * F.avg(F.when(test, 1.0).otherwise(0.0)), 1)
    return [share(~o & ~r).alias("one_to_one"), share(~o & r).alias("one_to_n"), share(o & r).alias("n_to_n"), share(o & ~r).alias("n_to_one")]
