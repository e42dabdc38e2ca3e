"""Mixing sources to target weights by iterative proportional fitting.

Token counts are raked to marginals of source, language and topic: each step scales the
cells of one dimension's value to its target, in blocks of ROUNDS rounds until every marginal
is within TOLERANCE of its target (or MOST_BLOCKS; targets that contradict each other cannot
all be met, and `marginals` shows what was). A document is then kept with its cell's
calibrated probability: the weighted share of the token budget over the cell's tokens. Where
that is over 1 the whole cell is kept, and what it lacks goes to the other cells by their
weights, so that the budget is met as long as there are tokens. All of it is DataFrame
functions.

Documents reduce to cells (with map-side combine) before any exchange; the raking works
on the cells alone. Null sources, languages and topics are a value of their own,
`(null)`. Texts without tokens are kept with their cell's probability, 1 where the cell
has none. The draw is a hash of seed and doc_id (of the text where that is null), so
repeated rows are kept or dropped together, and a rerun keeps the same rows. Added columns start with two underscores, so
no ordinary name clashes. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemeter.llm.common import cut, n_bytes

DIMENSIONS = ("source", "lang", "topic")
#: Exponent of a value's token share that makes its target: below 1 it lifts small ones.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS = 8
TOLERANCE = 1e-10
MOST_BLOCKS = 12
BUDGET = 0.6
SEED = 20240607
#: Up to so many cells are raked in one task, without exchanges; more stay distributed. The results are
#: equal up to the rounding of sums.
LOCAL_CELLS = 100_000


def tokens(text: Column) -> Column:
    """Four bytes a token, rounded up: the stand-in where no counted column is given."""
    return F.floor((n_bytes(text) + 3) / 4).cast("long")


def topic(text: Column) -> Column:
    """Stand-in topic by layout: many short lines, long, or prose."""
    size = n_bytes(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isNull(), F.lit("prose")).when(lines * 120 > size, "lines").when(size >= 8192, "long").otherwise("prose")


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from seed and id, or the text's digest where the id is null."""
    named = F.coalesce(doc_id.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), named))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def described(docs: DataFrame, text_col: str = "text", tokens_col: str | None = None, topic_col: str | None = None) -> DataFrame:
    """Adds __source, __lang, __topic and __tokens."""
    named = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic_col) if topic_col else topic(F.col(text_col))}
    made = {f"__{d}": F.coalesce(c.cast("string"), F.lit("(null)")) for d, c in named.items()}
    return docs.withColumns(made | {"__tokens": F.col(tokens_col).cast("long") if tokens_col else tokens(F.col(text_col))})


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS, with_targets: bool = False) -> DataFrame:
    """Cells (__source, __lang, __topic, tokens) with weight added; weights sum to about 1.

    targets: for a dimension, (value, target); a value it lacks has target 0. Without one
    a dimension's targets are its token shares to the power `temper`, scaled to sum to 1. with_targets
    leaves them in, as __t_ columns.
    """
    whole = Window.partitionBy(F.lit(1))
    out = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(whole))
    for d in DIMENSIONS:
        if targets and d in targets:
            given = targets[d].select(F.col("value").cast("string").alias(f"__{d}"), F.col("target").cast("double").alias(f"__t_{d}"))
            out = out.join(given, f"__{d}", "left").fillna(0.0, [f"__t_{d}"])
        else:
            share = cells.groupBy(f"__{d}").agg(F.sum("tokens").alias("n")).withColumn("p", F.pow(F.col("n").cast("double"), F.lit(temper[d])))
            aim = share.select(f"__{d}", (F.col("p") / F.sum("p").over(whole)).alias(f"__t_{d}"))
            out = out.join(aim, f"__{d}")
    out = cut(out, "cells")
    few = out.count() <= LOCAL_CELLS
    for _ in range(MOST_BLOCKS):
        out = out.coalesce(1) if few else out
        for _ in range(rounds):
            for d in DIMENSIONS:
                held = F.sum("weight").over(Window.partitionBy(f"__{d}"))
                out = out.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"__t_{d}") / held).otherwise(0.0))
        out = cut(out, "cells")
        off = [out.groupBy(f"__{d}").agg(F.abs(F.sum("weight") - F.first(f"__t_{d}")).alias("off")) for d in DIMENSIONS]
        if (reduce(DataFrame.unionByName, (x.select("off") for x in off)).agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return out if with_targets else out.drop(*(f"__t_{d}" for d in DIMENSIONS))


def marginals(docs: DataFrame, budget: float = BUDGET, **options) -> DataFrame:
    """(dimension, value, target, weight, share): for documents as `described` made them, what the raked
    weights give each value and its share of the tokens expected to be kept."""
    cells = _probable(rake(_cells(docs), with_targets=True, **options), budget)
    kept = F.col("prob") * F.col("tokens")
    one = cells.agg(F.sum(kept).alias("__all"))
    rows = [cells.groupBy(F.lit(d).alias("dimension"), F.col(f"__{d}").alias("value")).agg(F.first(f"__t_{d}").alias("target"), F.sum("weight").alias("weight"), F.sum(kept).alias("kept")) for d in DIMENSIONS]
    return reduce(DataFrame.unionByName, rows).join(F.broadcast(one)).select("dimension", "value", "target", "weight", F.try_divide("kept", "__all").alias("share"))  # one row


def _cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*(f"__{d}" for d in DIMENSIONS)).agg(F.sum("__tokens").alias("tokens"))


def _probable(cells: DataFrame, budget: float) -> DataFrame:
    """Cells with prob: min(1, level * weight / tokens), the level such that the budget is met."""
    whole = Window.partitionBy(F.lit(1))
    live = (F.col("weight") > 0) & (F.col("tokens") > 0)
    # cells whose tokens are few for their weight are kept whole first; level is that of the first that is not
    by = whole.orderBy("ratio", *(f"__{d}" for d in DIMENSIONS))
    upto, onwards = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = cells.withColumns({"ratio": F.when(live, F.col("tokens") / F.col("weight")), "w": F.when(live, F.col("weight")).otherwise(0.0), "t": F.when(live, F.col("tokens")).otherwise(F.lit(0))})
    left = F.lit(budget) * F.sum("tokens").over(whole) - (F.sum("t").over(upto) - F.col("t"))
    tried = ranked.withColumn("try", F.when(live, F.try_divide(left, F.sum("w").over(onwards))))
    level = F.min_by("try", F.when(F.col("try") <= F.col("ratio"), F.col("ratio"))).over(whole)
    prob = F.when(F.col("tokens") == 0, 1.0).when(~live, 0.0).when(F.col("level").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("level") / F.col("ratio")))
    return tried.withColumn("level", level).withColumn("prob", prob).drop("ratio", "w", "t", "try", "level")


def calibrated(docs: DataFrame, budget: float = BUDGET, **options) -> DataFrame:
    """Documents (as `described` made them) with __weight and __prob of their cell."""
    keys = [f"__{d}" for d in DIMENSIONS]
    weights = cut(_probable(rake(_cells(docs), **options), budget).select(*keys, F.col("weight").alias("__weight"), F.col("prob").alias("__prob")), "weights")
    return docs.join(weights, keys)


def mix(docs: DataFrame, budget: float = BUDGET, seed: int = SEED, text_col: str = "text", tokens_col: str | None = None, topic_col: str | None = None, **options) -> DataFrame:
    """The sampled documents, with __source, __lang, __topic, __tokens, and __weight and __prob of
    their cell added."""
    all_docs = calibrated(described(docs, text_col, tokens_col, topic_col), budget, **options)
    return all_docs.where(draw(F.col("doc_id"), F.col(text_col), seed) < F.col("__prob"))


def mix_sql(budget: float = BUDGET, seed: int = SEED, rounds: int = 3 * ROUNDS, table: str = "documents") -> str:
    """DuckDB SQL of the query's rows."""
    size = "coalesce(strlen(text), 0)"
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  CASE WHEN text IS NULL THEN 'prose' WHEN (length(text) - length(replace(text, chr(10), ''))) * 120 > {size} THEN 'lines'
       WHEN {size} >= 8192 THEN 'long' ELSE 'prose' END AS topic, ({size} + 3) // 4 AS tokens, md5(coalesce(text, '')) AS textkey FROM {table})""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        ctes.append(f"p_{x} AS (SELECT {x}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER[x]}) AS p FROM c GROUP BY ALL)")
        ctes.append(f"t_{x} AS (SELECT {x}, p / sum(p) OVER () AS t FROM p_{x})")
    joins = " ".join(f"JOIN t_{x} USING ({x})" for x in DIMENSIONS)
    ctes.append(f"w0 AS (SELECT source, lang, topic, tokens, t_source.t AS a, t_lang.t AS b, t_topic.t AS e, tokens / sum(tokens) OVER () AS w FROM c {joins})")
    k = 0
    for _ in range(rounds):
        for x, t in zip(DIMENSIONS, "abe"):
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {x}) > 0 THEN w * {t} / sum(w) OVER (PARTITION BY {x}) ELSE 0 END AS w) FROM w{k})")
            k += 1
    ctes += [
        f"x AS (SELECT *, w > 0 AND tokens > 0 AS live, CASE WHEN w > 0 AND tokens > 0 THEN tokens / w END AS ratio, sum(tokens) OVER () * CAST({budget} AS DOUBLE) AS whole FROM w{k})",
        "y AS (SELECT *, (whole - coalesce(sum(CASE WHEN live THEN tokens ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(CASE WHEN live THEN w ELSE 0 END) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS try FROM x WINDOW o AS (ORDER BY ratio NULLS FIRST, source, lang, topic))",
        "z AS (SELECT arg_min(try, ratio) AS level FROM y WHERE live AND try <= ratio)",
        "f AS (SELECT source, lang, topic, w, CASE WHEN tokens = 0 THEN 1.0 WHEN NOT live THEN 0.0 WHEN level IS NULL THEN 1.0 ELSE least(1.0, level / ratio) END AS prob FROM y, z)",
    ]
    u = f"CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), textkey)), 1, 8)) AS BIGINT) / 4294967296.0"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, source, lang, topic, tokens, round(w, 9) AS weight, round(prob, 9) AS prob FROM d JOIN f USING (source, lang, topic) WHERE {u} < prob"
