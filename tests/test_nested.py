import json

import pytest
from pyspark.sql import functions as F

from prosemeter import schemas
from prosemeter.operators import documents as D
from prosemeter.operators import evaluation as E
from prosemeter.operators import exchange as X
from prosemeter.operators import nested as N
from prosemeter.operators import scorers
from prosemeter.operators import stats as S
from prosemeter.plans import nested as P


def test_paths(spark):
    rows = spark.createDataFrame([({"gpt.4": {"content": "hi"}}, (("deep",),), 0)], "models map<string,struct<content:string>>, a struct<b:struct<c:string>>, zero int")
    get = lambda p: rows.select(N.get_path(rows, p)).first()[0]
    assert get("models.gpt.4.content") == "hi"
    assert get("a.b.c") == "deep"
    assert get("zero") is None
    assert get("a.x") == ""
    assert rows.select(N.get_path(rows, "zero", F.lit(7))).first()[0] == 7
    assert N.keyfact_path("m.x.content") == "m.x.keyfacts"
    assert N.keyfact_path("text") == "generated_keyfacts"
    put = N.set_path(rows, "a.b.d", F.lit(1)).first()
    assert (put["a"]["b"]["c"], put["a"]["b"]["d"]) == ("deep", 1)
    assert N.set_path(rows, "new.x", F.lit(2)).first()["new"]["x"] == 2


def test_detect_and_flatten(spark, tmp_path):
    record = {"original_data": {"original_data": {"popsci_article": {"title": "P", "content": "pc"}, "wikipedia_article": {"title": "W", "content": "wc"}, "source": "s"}}, "models": {"m1": {"title": "t", "content": "out"}}}
    path = tmp_path / "r.json"
    path.write_text(json.dumps([record]))
    rows = spark.read.schema(schemas.NESTED).option("multiLine", True).json(str(path))
    flat = N.flatten_record(rows).first()
    assert (flat["popsci_title"], flat["wiki_content"], flat["model_name"], flat["model_output"], flat["wiki_keyfacts"]) == ("P", "wc", "m1", "out", [])
    kind = spark.createDataFrame([(("t", "c"),)], "gpt struct<title:string,content:string>").schema
    assert N.detect_fields(kind) == {"model": "gpt", "text": "gpt.content", "title": "gpt.title"}


def test_facts(spark):
    got = {r["id"]: r["n"] for r in spark.createDataFrame(list(P.FACT_REPLIES), "id int, r string").select("id", F.size(N.facts_from_json(F.col("r"))).alias("n")).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 1, 5: 0}


def test_unwrap(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame(list(P.PAIR_REPLIES), "id int, g int, r string").select("id", F.size(N.unwrap_pairs(F.col("r")))).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}


def test_alignment_scores(spark, data):
    got = {(r["id"], r["priority"]): (r["precision"], r["recall"]) for r in P.keyfact_alignment(spark, data).collect()}
    assert got[(1, 0)] == (0.666667, 0.666667)
    assert got[(3, 0)] == (0.333333, 0.666667)
    assert got[(4, 0)] == (0.0, 0.0)
    assert got[(1, 2)] == (-1.0, -1.0)


def test_reply_scores(spark):
    rows = spark.createDataFrame(list(P.SCORE_REPLIES), "id int, n int, r string")
    got = {r[0]: r[1] for r in rows.select("id", N.parse_scores(F.col("r"), F.col("n"))).collect()}
    assert got == {1: [10, 9, 0], 2: [10, 9, 0], 3: [1, 2], 4: [4, 5], 5: [6, 8], 6: None, 7: None}


def test_sections(spark):
    got = {r[0]: [tuple(s) for s in r[1]] for r in spark.createDataFrame(list(P.WIKI), "id int, t string").select("id", N.sections(F.col("t"))).collect()}
    assert got[1] == [(None, "lead text"), ("== One ==", "first"), ("== Two ==", "second")]
    assert got[2] == [(None, "only lead")]
    assert got[3] == [("== A ==", "== B ==\nbody")]
    assert got[5] == []
    assert got[6] == [(None, "x"), ("== E ==", ""), ("== F ==", "y")]


def test_exchange(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    replies = spark.createDataFrame([("a", (200, ([(("hi",),)],))), ("b", (500, None))], X.RESPONSE)
    got = {r["custom_id"]: (r["reply"], r["problem"]) for r in X.merged(asked, replies, strict=False).collect()}
    assert got == {"a": ("hi", None), "b": (None, "status 500"), "c": (None, "missing")}
    with pytest.raises(Exception, match="no usable response"):
        X.merged(asked, replies).collect()
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert {tuple(r) for r in X.updated(rows, spark.createDataFrame([(2, "z")], "id int, v string"), "id").collect()} == {(1, "x"), (2, "z")}
    tries = spark.createDataFrame([("a", 1, None), ("a", 2, "timeout"), ("b", 1, "e")], "k string, attempt int, error string")
    assert {tuple(r) for r in X.best_attempt(tries, "k").collect()} == {("a", 1, None), ("b", 1, "e")}


def test_scorer_isolates_failures(spark):
    def make():
        def score(texts):
            return [1 / len(t) for t in texts]

        return score

    col = scorers.scorer_column(make)
    rows = spark.createDataFrame([("ab",), ("",), (None,)], "t string").coalesce(1)
    assert sorted(r[0] for r in rows.select(col(F.col("t"))).collect()) == [-1.0, -1.0, 0.5]
    lm = scorers.scorer_column(scorers.unigram_perplexity({"a": 3, "b": 1}))
    got = [r[0] for r in rows.select(lm(F.col("t"))).collect()]
    assert got[1] == 1000.0 and got[0] > 1


def test_evaluation(spark):
    docs = spark.createDataFrame([(1, "A beautiful day. It was nice."), (2, "..."), (3, None), (4, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in E.evaluate(docs, perplexity=lambda c: F.lit(60.0)).collect()}
    assert out[2]["simplicity_fkgl_score"] == -1 and out[2]["simplicity_interpretation"] == "Evaluation failed"
    assert out[1]["coherence_interpretation"] == "Relatively fluent"
    assert out[3]["coherence_ppl_score"] == -1 and out[3]["vividness_score"] == 0
    stats = {r["metric"]: r["count"] for r in E.statistics(E.evaluate(docs, perplexity=lambda c: F.lit(60.0))).collect()}
    assert stats["coherence_ppl_score"] == 2 and stats["vividness_score"] == 4 and "informativeness_score" not in stats
    assert "simplicity_fkgl_score" not in E.evaluate(docs, skip=frozenset({"simplicity"})).columns


def test_statistics(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (-1.0,)], "v double").withColumn("k", F.lit(1))
    r = S.study_statistics(v, "v", ["k"]).first()
    assert (r["median"], r["n"]) == (3.0, 4)
    assert S.histogram(v, F.col("v"), 0, 10, 10).where("bin = 0").first()["n"] == 1


def test_comparisons(spark):
    row = spark.createDataFrame([(1.0, 1.0, 0.5, 0.52)], "a double, b double, c double, d double")
    said, winner = D.compare_vividness(F.col("c"), F.col("d"))
    assert row.select(D.compare("a", "b"), said, winner).first()[:] == ("text_2", "Both texts have similar vividness", "text2")
