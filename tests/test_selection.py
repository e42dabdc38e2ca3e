"""Sample and subset filters, map unions, whole evaluations, and rows that lack or repeat their keys."""

import json
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prosemeter.functions import buckets as B
from prosemeter.functions import text as T
from prosemeter.functions import words as W
from prosemeter.operators import documents as D
from prosemeter.operators import evaluation as E
from prosemeter.operators import nested as N
from prosemeter.operators import questions as Q
from prosemeter.operators import scenes as Sn
from prosemeter.operators import scorers as Sc
from prosemeter.operators import stats as S
from prosemeter.sources import readers, writers


def test_first_rows_and_indices(spark):
    rows = spark.createDataFrame([(k,) for k in (5, 3, 1, 4)], "k long")
    assert [r[0] for r in S.first_rows(rows, ["k"], 2).collect()] == [1, 3]
    assert S.first_rows(rows, ["k"], None).count() == S.first_rows(rows, ["k"], 0).count() == 4 and S.first_rows(rows, ["k"], 9).count() == 4
    assert {r[0] for r in S.at_indices(rows, "k", [1, 5, 8]).collect()} == {1, 5}
    assert S.at_indices(rows, "k", None).count() == 4 and S.at_indices(rows, "k", []).count() == 0


def test_perplexity_study(spark):
    rows = [("a", k, "x" * (60 if k != 2 else 40), float(10 + k)) for k in range(8)] + [("a", 8, "y" * 70, 20_000.0), ("b", 0, " " * 80, 5.0)]
    got = S.perplexity_study(spark.createDataFrame(rows, "side string, k int, text string, ppl double"), "ppl", "text", ["side"], ["k"], first=5).collect()
    assert [(r["side"], r["n"], r["mean"]) for r in got] == [("a", 4, (10 + 11 + 13 + 14) / 4)]


def test_maps_and_subsets(spark):
    row = spark.range(1).select(
        N.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.lit(None).cast("map<string,int>"), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(None).cast("int"))).alias("m"),
        N.is_subset(F.array(F.lit(1), F.lit(1)), F.array(F.lit(2), F.lit(1))).alias("yes"), N.is_subset(F.array(F.lit(3)), F.array(F.lit(1))).alias("no"),
    ).first()
    assert row["m"] == {"a": 1, "b": 3, "c": None} and row["yes"] and not row["no"]


def test_international_tokens(spark):
    text = "Hello, world! 3.5 % of $5 (1,000) 12. a-b"
    assert spark.range(1).select(T.normalize(F.lit(text), tokenizer="intl")).first()[0] == "hello , world ! 3.5 % of $ 5 ( 1,000 ) 12 . a - b"


def test_level_summary(spark):
    levels = spark.createDataFrame([(2.0,), (4.0,), (None,)], "level double")
    r = D.level_summary(levels, B.CEFR).first()
    assert (r["average_level"], r["min_level"], r["max_level"], r["total_texts"], r["valid_texts"]) == (3.0, 2.0, 4.0, 3, 2)
    assert D.level_summary(levels.where("level is null"), B.CEFR).first()["average_level_name"] == "N/A"


def test_rows_without_or_with_equal_keys(spark):
    rows = [(None, "One two three."), (None, "Four five."), (7, "Same id."), (7, "Same id."), (8, None)]
    got = D.readability_by_row(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == sorted([("None", 3), ("None", 2), ("7", 2), ("7", 2), ("8", 0)])


def test_flat_record_keeps_relevance(spark):
    article = {"title": "t", "content": "c", "url": "u"}
    row = ({"original_data": {"popsci_article": article, "wikipedia_article": article, "source": "s"}, "analysis": {N.RELEVANCE: 7}}, {"m.1": {"title": "x", "content": "y"}})
    kind = "struct<title:string,content:string,url:string>"
    schema = f"original_data struct<original_data:struct<popsci_article:{kind},wikipedia_article:{kind},source:string>,analysis:struct<`{N.RELEVANCE}`:int>>, models map<string,struct<title:string,content:string>>"
    flat = N.flatten_record(spark.createDataFrame([row], schema)).first()
    assert flat["content_relevance_score"] == 7 and flat["model_name"] == "m.1" and flat["wiki_keyfacts"] == []


def test_assembled_evaluation(spark):
    docs = spark.createDataFrame([(1, "A very lovely text. It is short."), (2, "  "), (3, "Another one, quite plainly.")], "doc_id long, text string")
    facts = spark.createDataFrame([(1, 0, 0.5, 0.25), (1, 1, 1.0, -1.0), (3, 0, -1.0, 0.0)], "doc_id long, priority int, precision double, recall double")
    quiz = spark.createDataFrame([(1, [("A",), ("B",)], ["a", "c"]), (2, [("A",)], [])], "doc_id long, questions array<struct<answer:string>>, answers array<string>")
    replies = spark.createDataFrame([(1, "Coherence: 4"), (1, "5"), (3, "nothing")], "doc_id long, reply string")
    whole = E.assemble(E.evaluate(docs), ["doc_id"], facts, quiz, replies)
    by_id = {r["doc_id"]: r for r in whole.collect()}
    assert by_id[1]["keyfacts_precision_by_priority"] == {"priority_1": 1.0} and by_id[1]["informativeness_score"] == 0.5 and by_id[1]["coherence_llm_score"] == 4.5
    assert by_id[2]["keyfacts_precision"] is None and by_id[2]["informativeness_score"] == 0.0 and by_id[3]["coherence_llm_score"] == -1.0
    stats = {r["metric"]: r for r in E.statistics(E.output_records(whole)).collect()}
    assert stats["keyfacts_precision_by_priority.priority_1"]["count"] == 1 and stats["keyfacts_recall"]["mean"] == 0.125
    assert stats["coherence_llm_score"]["count"] == 1 and stats["informativeness_score"]["mean"] == 0.25
    assert "keyfacts_recall_by_priority.priority_1" not in stats and "coherence_ppl_score" not in stats


def test_replaced_at_every_moment(spark, tmp_path):
    path = f"file://{tmp_path}/data"
    read = lambda: sorted(r["k"] for r in spark.read.json(path).collect())
    writers.replaced(spark.createDataFrame([(1,)], "k long"), path)
    writers.replaced(spark.read.json(path).selectExpr("k + 1 as k"), path)  # reads what it replaces
    assert read() == [2] and os.listdir(tmp_path) == ["data"]
    os.rename(tmp_path / "data", tmp_path / "data.old")  # as an interrupted call leaves it
    writers.replaced(spark.createDataFrame([(9,)], "k long"), path)
    assert read() == [9] and os.listdir(tmp_path) == ["data"]


def test_joined_perplexity(spark):
    rows = [(1, "a a b"), (2, "c"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "k int, text string")
    counts, score = Counter("a a b c".split()), Sc.unigram_perplexity(Counter("a a b c".split()))()
    got = {r["k"]: r["perplexity"] for r in Sc.unigram_perplexity_of(docs, "text", ["k"]).collect()}
    assert got == {k: pytest.approx(score([t or ""])[0]) for k, t in rows}
    assert Sc.word_counts(docs, "text") == counts and math.isclose(got[3], 1000)
    with pytest.raises(ValueError):
        Sc.word_counts(docs, "text", most=2)


def test_samsa(spark):
    texts = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "k int, n_sentences int")
    scenes = [(1, ["runs"], [["dog"], ["cat", "hat"]], ["runs", "dog", "cat"]), (1, [], [], ["x"]), (2, ["a"], [["b"]], ["a", "b"]), (4, ["a"], [["b"], []], None)]
    table = spark.createDataFrame(scenes, "k int, relation array<string>, participants array<array<string>>, words array<string>")
    got = {r["k"]: r["samsa"] for r in Sn.samsa(texts, table, ["k"]).collect()}
    assert got == {1: pytest.approx(100 * 2 / 4 * (0.5 + 0.25 + 0.25 + 0.25)), 2: 0.0, 3: 0.0, 4: pytest.approx(100 * 0.5 * 0.25)}
    same = [{"relation": True, "participants": [True, False]}, {"relation": None, "participants": []}]
    assert got[1] == pytest.approx(100 * W.samsa_score(same, 2))
    assert Sn.corpus_samsa(texts, table, ["k"]).first()["n"] == 4
    assert spark.range(1).select(Sn.scene_sentences(F.array(F.array(F.lit(3), F.lit(1)), F.array(F.lit(5), F.lit(2))))).first()[0] == [1, 0]


def test_vector_score(spark):
    rows = [(1, [[1.0, 0.0], [0.0, 2.0]], [[[0.0, 1.0]], [[3.0, 0.0], [0.0, 1.0]]]), (2, [[1.0, 0.0]], [[[0.0, 1.0]]]), (3, [[1.0, 0.0]], [])]
    df = spark.createDataFrame(rows, "k int, out array<array<double>>, refs array<array<array<double>>>")
    got = {r["k"]: r["s"] for r in df.select("k", Sn.vector_score("out", "refs").alias("s")).collect()}
    assert got[1]["f1"] == pytest.approx(1.0) and got[2]["f1"] == 0.0 and got[3]["f1"] is None
    assert Sn.corpus_vector_score(df, "out", "refs").first()["f1"] == pytest.approx(50.0)


def test_question_chain(spark):
    fact = lambda e: {"entity": e, "behavior": "b", "context": None, "priority": 1}
    docs = spark.createDataFrame([("d1", "text one"), ("d2", "  "), ("d3", "text three")], "id string, text string")
    assert [r["custom_id"] for r in Q.extraction_requests(docs, "id", "text", "Facts of: {text}", "m").orderBy("custom_id").collect()] == ["d1", "d3"]
    replies = lambda rows: spark.createDataFrame(rows, "custom_id string, reply string")
    matched = replies([("d1", json.dumps([[fact(f"e{k}"), fact("t")] for k in range(30)])), ("d3", "nothing")])
    asked = Q.quiz_requests(matched, "{num_questions} about {keyfacts}", "m").collect()
    prompt = asked[0]["body"]["messages"][0]["content"]
    assert len(asked) == 1 and prompt.startswith("5 about [") and prompt.count("entity") == 20
    quiz = replies([("d1", '```json\n[{"question":"q","options":{"A":"x"},"answer":" a"},{"question":"r","options":{},"answer":"B"}]\n```'), ("d3", "[]")])
    read = Q.reader_requests(docs, "id", "text", quiz, {"adult": "{article}? {questions}", "child": "C {article}"}, "m", "child").collect()
    assert [(r["custom_id"], r["body"]["messages"][0]["content"]) for r in read] == [("d1", "C text one")]
    got = {r["id"]: (r["informativeness_score"], r["n_questions"]) for r in Q.informativeness(docs, "id", quiz, replies([("d1", '["A","c"]')])).collect()}
    assert got == {"d1": (0.5, 2), "d2": (0.0, 0), "d3": (0.0, 0)}


def test_piped_lines_and_fixed_width(spark):
    rows = readers.piped_lines(spark, ["one\n", "  two \r\n", "\n"])
    assert [tuple(r) for r in rows.collect()] == [(0, "one"), (1, "two"), (2, "")]
    assert writers.fixed_width(rows, 2) == "row_id | text\n------ | ----\n0      | one\n1      | two\n..."
