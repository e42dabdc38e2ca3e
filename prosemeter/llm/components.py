"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.llm.common import remove, written

#: Tasks that the neighbours of one node spread over.
SALT = 16


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of any ordered type -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds; each is an aggregation with map-side
    combine and an equi-join on the node and one of SALT values, so a hub's neighbours are
    neither gathered in one row nor in one task. The edge table is written and reread after
    each round. Self-loops and nulls are dropped; nodes without an edge do not appear. An
    empty table gives an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    e, path = written(e, "edges")
    before = _mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last = path
        e, path = written(_small_star(_large_star(e)), "edges")
        remove(e.sparkSession, last)  # a lost executor rereads the new table
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Rows (u, v) with the value m that `low` (x, m) has for u; hubs are spread over SALT tasks."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    copies = low.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return dealt.join(copies.hint("merge"), (F.col("u") == F.col("x")) & (dealt["salt"] == copies["salt"])).select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    far = _with_low(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
    near = _with_low(e, low)
    out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
