"""Inputs that several registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are long to compute on: dealt out where its files give fewer tasks than
    there are cores (a small table in one row group); larger inputs are read as they lie."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def turns(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(conv_id, turn, t0 .. tn-1): each run of n consecutive turns, by one grouping on
    (conv_id, turn), so that a long conversation spreads over tasks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")  # the grouping below deals it out
    roles = c.select("conv_id", F.posexplode(F.array(*(F.col("turn") - i for i in range(n)))).alias("i", "turn"), "text")
    wide = roles.groupBy("conv_id", "turn").agg(*(F.max(F.when(F.col("i") == i, F.col("text"))).alias(f"t{i}") for i in range(n)))
    return wide.dropna(subset=[f"t{i}" for i in range(n)])


#: Neighbouring turns that `turn_runs` gathers in one row.
BLOCK = 16


def turn_runs(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """As `turns`, but the grouping is on blocks of neighbouring turns: a text is sent once, or twice where a run
    that starts in the block before takes it in, instead of n times. The rows are not dealt out by turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # blocks start in the middle between multiples, so that a short conversation lies in one
    at = F.pmod(F.col("turn") + BLOCK // 2, F.lit(BLOCK))
    place = lambda start, i: F.struct(start.alias("start"), i.alias("i"))
    start = F.col("turn") - at
    own, before = place(start, at), place(start - BLOCK, at + BLOCK)
    # no turn: a row is at every place of a run, as in `turns`
    lost = F.array(*(place(start, F.coalesce(at, F.lit(i))) for i in range(n)))
    places = F.when(F.col("turn").isNull(), lost).when(at < n - 1, F.array(own, before)).otherwise(F.array(own))
    wide = c.select("conv_id", "text", F.inline(places)).groupBy("conv_id", "start").agg(*(F.max(F.when(F.col("i") == i, F.col("text"))).alias(f"__{i}") for i in range(BLOCK + n - 1)))
    runs = F.array(*(F.struct((F.col("start") + i).alias("turn"), *(F.col(f"__{i + j}").alias(f"t{j}") for j in range(n))) for i in range(BLOCK)))
    return wide.select("conv_id", F.inline(runs)).dropna(subset=[f"t{i}" for i in range(n)])


def turns_sql(n: int) -> str:
    picks = ", ".join(f"max(CASE WHEN i = {i} THEN text END) AS t{i}" for i in range(n))
    rows = " UNION ALL ".join(f"SELECT conv_id, turn - {i} AS turn, {i} AS i, text FROM conversations" for i in range(n))
    have = " AND ".join(f"t{i} IS NOT NULL" for i in range(n))
    return f"SELECT * FROM (SELECT conv_id, turn, {picks} FROM ({rows}) x GROUP BY conv_id, turn) y WHERE {have}"


def samples(spark: SparkSession, sf_dir: str, of: Callable[[SparkSession, str, int], DataFrame] = turns) -> DataFrame:
    """(conv_id, turn, orig, sys, refs): a turn, the next, and the two after that."""
    return of(spark, sf_dir, 4).select("conv_id", "turn", F.col("t0").alias("orig"), F.col("t1").alias("sys"), F.array("t2", "t3").alias("refs"))
