"""Interpretation labels and piecewise scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (upper bound, label), the last without a bound.
PPL = ((0, "Evaluation failed"), (50, "Very fluent"), (100, "Relatively fluent"), (200, "Moderately fluent"), (500, "Less fluent"), (None, "Not fluent"))
PPL_STUDY = ((50, "Very Fluent"), (100, "Relatively Fluent"), (200, "Moderately Fluent"), (500, "Less Fluent"), (None, "Very Disfluent"))
FKGL = ((8, "Very simple (elementary level)"), (12, "Relatively simple (middle school level)"), (16, "Moderately simple (high school level)"), (None, "Not simple (college level or above)"))
FKGL_LEVEL = ((8, "Elementary level"), (12, "Middle School level"), (16, "High School level"), (None, "College level or above"))
GAP = ((2, "Similar readability"), (5, "Moderate simplification gap"), (None, "Significant simplification gap"))
CEFR = ((1, "A1 (Beginner)"), (2, "A2 (Elementary)"), (3, "B1 (Intermediate)"), (4, "B2 (Upper Intermediate)"), (5, "C1 (Fluent)"), (None, "C2 (Proficient)"))
VIVIDNESS = ((0.2, "Minimal vividness"), (0.4, "Low vividness"), (0.6, "Moderate vividness"), (0.8, "High vividness"), (None, "Extremely vivid"))
EMOTIONALITY = ((0.2, "Minimal emotional expression"), (0.4, "Mild emotional richness"), (0.7, "Moderate emotional richness"), (None, "High emotional richness"))
DECORATIVENESS = ((0.2, "Minimal decorativeness"), (0.4, "Low decorativeness"), (0.7, "Moderate decorativeness"), (None, "High decorativeness"))
FIGURATIVENESS = ((0.2, "Low"), (0.4, "Medium"), (None, "High"))


def bucket(score: Column, bounds: tuple, inclusive: bool = False) -> Column:
    """The label of the first bound that the score is below (or at, if inclusive)."""
    out = None
    for top, label in bounds:
        if top is None:
            return out.otherwise(F.lit(label))
        test = score <= top if inclusive else score < top
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def bucket_sql(score: str, bounds: tuple, inclusive: bool = False) -> str:
    op = "<=" if inclusive else "<"
    return "CASE " + " ".join(f"WHEN {score} {op} {top} THEN '{label}'" if top is not None else f"ELSE '{label}'" for top, label in bounds) + " END"


def ppl_label(score: Column) -> Column:
    return bucket(score, PPL)


def fkgl_label(score: Column) -> Column:
    return F.when(score < 0, "Evaluation failed").otherwise(bucket(score, FKGL, True))


def decorative_intensity(x: Column) -> Column:
    return F.when(x <= 0.05, x * 4).when(x <= 0.15, 0.2 + (x - 0.05) * 3).when(x <= 0.30, 0.5 + (x - 0.15) * 2).otherwise(F.least(0.8 + (x - 0.30), F.lit(1.0)))


#: Weights of figurativeness, emotionality and decorativeness in vividness.
WEIGHTS = (0.4, 0.3, 0.3)


def vividness(fig: Column, emo: Column, dec: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    if any(not 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 0.001:
        raise ValueError(f"weights must lie in [0, 1] and sum to 1, not {weights}")
    return weights[0] * fig + weights[1] * emo + weights[2] * dec
