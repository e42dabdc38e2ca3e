"""Informativeness by questions, as stages of requests and replies: facts are extracted and matched,
questions made from what matched, a reader of some age answers from the text, answers are counted.

Every stage is a table of requests; its replies come back as (custom_id, reply) and go into the next.
Prompts are given by the caller, with {placeholders}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemeter.functions import text as T
from prosemeter.operators import nested as N
from prosemeter.operators.exchange import requests

QUESTIONS = "array<struct<question:string,options:map<string,string>,answer:string>>"
MOST_FACTS = 20
N_QUESTIONS = 5


def extraction_requests(rows: DataFrame, custom_id: str, text: str, prompt: str, model: str) -> DataFrame:
    """Facts of texts; blank texts ask nothing. Placeholder: text."""
    asked = rows.where(F.length(T.strip(F.coalesce(F.col(text), F.lit("")))) > 0)
    return requests(asked, F.col(custom_id), T.fill_template(F.lit(prompt), text=F.col(text)), model)


def match_requests(rows: DataFrame, custom_id: str, truth: str, generated: str, prompt: str, model: str) -> DataFrame:
    """Matches of two columns of facts. Placeholders: ground_truth_key_facts, generated_key_facts."""
    filled = T.fill_template(F.lit(prompt), ground_truth_key_facts=F.to_json(truth), generated_key_facts=F.to_json(generated))
    return requests(rows, F.col(custom_id), filled, model)


def target_facts(reply: Column, most: int = MOST_FACTS) -> Column:
    """The generated facts of a match reply, the first `most` (a limit of the question prompt)."""
    return F.slice(F.transform(N.unwrap_pairs(reply), lambda p: p[0]), 1, most)


def quiz_requests(matched: DataFrame, prompt: str, model: str, n: int = N_QUESTIONS) -> DataFrame:
    """(custom_id, reply) of matches -> questions; where nothing matched none are asked. Placeholders:
    num_questions, keyfacts."""
    facts = matched.select("custom_id", target_facts(F.col("reply")).alias("facts")).where(F.size("facts") > 0)
    return requests(facts, F.col("custom_id"), T.fill_template(F.lit(prompt), num_questions=F.lit(str(n)), keyfacts=F.to_json("facts")), model)


def questions(reply: Column) -> Column:
    """The questions of a reply; none where it is not a list of them."""
    return F.coalesce(F.from_json(T.strip_fences(reply), QUESTIONS), F.array().cast(QUESTIONS))


def reader_requests(rows: DataFrame, custom_id: str, text: str, quizzes: DataFrame, prompts: dict[str, str], model: str, age: str = "adult") -> DataFrame:
    """A reader's answers from the text; an unknown age reads as `adult`. Placeholders: article, questions."""
    asked = rows.join(quizzes.select(F.col("custom_id").alias(custom_id), questions(F.col("reply")).alias("__quiz")), custom_id).where(F.size("__quiz") > 0)
    filled = T.fill_template(F.lit(prompts.get(age, prompts["adult"])), questions=F.to_json("__quiz"), article=F.col(text))
    return requests(asked, F.col(custom_id), filled, model)


def informativeness(rows: DataFrame, custom_id: str, quizzes: DataFrame, answers: DataFrame) -> DataFrame:
    """(custom_id, informativeness_score, n_questions), a row for each of `rows`; 0 unless as many answers
    as questions came back."""
    asked = quizzes.select(F.col("custom_id").alias(custom_id), questions(F.col("reply")).alias("q"))
    given = answers.select(F.col("custom_id").alias(custom_id), F.from_json(T.strip_fences(F.col("reply")), "array<string>").alias("a"))
    j = rows.select(custom_id).join(asked, custom_id, "left").join(given, custom_id, "left")
    return j.select(custom_id, F.coalesce(N.mcq_accuracy(F.col("q"), F.coalesce("a", F.array().cast("array<string>"))), F.lit(0.0)).alias("informativeness_score"), F.coalesce(F.size("q"), F.lit(0)).alias("n_questions"))
