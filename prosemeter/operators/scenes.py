"""Scene-based simplification scores over tables of scenes, and greedy token matching over vectors.

Scenes and vectors come from parsers and models outside; these operators take them as columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prosemeter.functions.words import match_scenes

PRF = Ty.StructType([Ty.StructField(c, Ty.DoubleType()) for c in ("precision", "recall", "f1")])


def covered(centres: Column, words: Column) -> Column:
    """1 if all minimal centres are among a scene's matched words, 0 if not, a half without centres."""
    none = centres.isNull() | (F.size(centres) == 0)
    return F.when(none, 0.5).when(F.size(F.array_except(centres, F.coalesce(words, F.array().cast("array<string>")))) == 0, 1.0).otherwise(0.0)


def samsa(texts: DataFrame, scenes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, samsa in [0, 100]), a row a text.

    texts: (keys, n_sentences of the output); scenes: (keys, relation, participants, words), a row a scene
    of the source: its relation's minimal centres, each participant's, and its words that the matched
    output sentence has. Texts with fewer scenes than sentences, or none, score 0.
    """
    people = F.transform(F.coalesce("participants", F.array().cast("array<array<string>>")), lambda p: covered(p, F.col("words")))
    mean = F.when(F.size(people) > 0, F.aggregate(people, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(people), F.lit(1))).otherwise(0.5)
    sums = scenes.select(*keys, (0.5 * covered(F.col("relation"), F.col("words")) + 0.5 * mean).alias("s")).groupBy(*keys).agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    score = F.when(F.col("n") >= F.col("n_sentences"), 100 * F.col("n_sentences") / (F.col("n") * F.col("n")) * F.col("s")).otherwise(0.0)
    return texts.select(*keys, "n_sentences").join(sums, keys, "left").select(*keys, F.coalesce(score, F.lit(0.0)).alias("samsa"))


def corpus_samsa(texts: DataFrame, scenes: DataFrame, keys: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, samsa, n): mean over texts; `by` are among the keys."""
    return samsa(texts, scenes, keys).groupBy(*by).agg(F.avg("samsa").alias("samsa"), F.count("*").alias("n"))


@F.pandas_udf(Ty.ArrayType(Ty.IntegerType()))
def scene_sentences(lengths: pd.Series) -> pd.Series:
    """The output sentence of each scene, from a row's table of alignment lengths (scene by sentence)."""
    return pd.Series([None if x is None else match_scenes([list(r) for r in x]) for x in lengths])


def _greedy(out: np.ndarray, ref: np.ndarray) -> tuple[float, float, float]:
    if not len(out) or not len(ref):
        return 0.0, 0.0, 0.0
    unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (out, ref)]
    near = unit[0] @ unit[1].T
    p, r = float(near.max(axis=1).mean()), float(near.max(axis=0).mean())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@F.arrow_udf(PRF)
def vector_score(out: pa.Array, refs: pa.Array) -> pa.Array:
    """Precision, recall and F1 of greedy token matching by cosine: an output's token vectors against those
    of each reference (an array of arrays of vectors); the reference with the best F1 counts."""
    as_matrix = lambda v: np.array(v, dtype=float) if v else np.zeros((0, 1))
    rows = [max((_greedy(as_matrix(o), as_matrix(r)) for r in rs or []), key=lambda s: s[2], default=(None, None, None)) for o, rs in zip(out.to_pylist(), refs.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(3)], names=["precision", "recall", "f1"])


def corpus_vector_score(rows: DataFrame, out: str, refs: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, precision, recall, f1, n), in percent, means over rows with a reference."""
    scored = rows.select(*by, vector_score(F.col(out), F.col(refs)).alias("s")).where("s.f1 is not null")
    return scored.groupBy(*by).agg(*((100 * F.avg(f"s.{c}")).alias(c) for c in ("precision", "recall", "f1")), F.count("*").alias("n"))
