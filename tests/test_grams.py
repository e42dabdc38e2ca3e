"""Gram sums within a row against the plain ways: regular expressions, lambdas, grams as rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosemeter.functions import grams as G
from prosemeter.functions import text as T
from prosemeter.operators import simplification as M
from prosemeter.plans import simplification as P
from prosemeter.plans.common import turn_runs, turns

ODD = [*"aB9 .,-!\"'&;$/\t\n\xa0é…", "..", ",.", "5.", ".5", "9,000", "-\n", "<skipped>", "&quot;", "&amp;lt;", "x-y", "3-4", "😀", " ", "É"]


def strings(n, parts, most, seed):
    r = random.Random(seed)
    return ["".join(r.choices(parts, k=r.randint(0, most))) for _ in range(n)]


def listed(texts, cuts):
    code, starts, words = G.tokens(pa.array(texts), cuts)
    words = words.to_pylist()
    return [[words[c] for c in code[i:j]] for i, j in zip(starts, starts[1:])]


def test_tokens_are_those_of_13a(spark):
    texts = ["", " ", ".", "5.", "1.5", "a..5", "5..5", "5...5", "5-6-7", "Mr. Smith, 3.5% -- (x)."] + strings(4000, ODD, 14, 1) + strings(4000, ["5", ".", ",", "-", "a", " "], 9, 2)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.words(F.col("t"), False).alias("w")).orderBy("i").collect()
    assert listed(texts, True) == [r["w"] for r in rows]


def test_tokens_between_spaces():
    assert listed(["", "a.b 5-6", "\xa0 x", "a b a"], False) == [[], ["a.b", "5-6"], ["\xa0", "x"], ["a", "b", "a"]]
    assert listed([""], True) == [[]]


def test_syllables(spark):
    parts = ["a", "e", "i", "o", "u", "y", "b", "l", "m", "q", "g", "ism", "coal", "llien", "ely", "dnt", "mc", "gua", "qua", "iaal", "é", "sia", "7"]
    words = list(dict.fromkeys([*T.SYLLABLES, "e", "ee", "mbl", "coal", *filter(None, strings(4000, parts, 6, 3))]))
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", T.syllables(F.col("w")).alias("n")).orderBy("i").collect()
    assert G.syllables(pa.array(words)).tolist() == [r["n"] for r in rows]


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Few words, so that grams repeat; sources in a row, references of any number, nulls."""
    r, out = random.Random(4), []
    of = lambda n: " ".join(r.choices(["a", "b", "The", "cat.", "5.5", "x-y,", "!"], k=r.randint(0, n)))
    for i in range(60):
        orig = r.choice([None, "", of(30), of(30)])
        refs = r.choice([[], [of(20)], [of(20), None], [of(20) for _ in range(4)], [orig, of(9)]])
        out += [(i, f"s{j}", orig, r.choice([None, "", orig, of(25), of(25)]), refs) for j in range(r.randint(1, 7))]
    out += [(99, "none", "", "", [""]), (99, "unpaired", "a b", "a b", []), (99, "lost", "a b", "a b", None)]
    return spark.createDataFrame(out, "i int, system string, orig string, sys string, refs array<string>").coalesce(1)


def same(got, want, keys):
    a, b = ({tuple(r[k] for k in keys): r.asDict() for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) > 1
    for k, row in b.items():
        assert a[k] == {c: pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for c, x in row.items()}


@pytest.mark.parametrize("size", [G.BYTES, 40])
@pytest.mark.parametrize("by", [["i", "system"], ["system"]])
def test_sari_against_grams_as_rows(odd_rows, by, size, monkeypatch):
    monkeypatch.setattr(G, "BYTES", size)
    keys, tokenised = ["i", "system"], M.tokenised(odd_rows)
    for options in ({}, {"micro": True}, {"f1_deletion": False}):
        want = M.sari_scores(M.sari_stats(M.gram_counts(tokenised, keys), by), by, **options)
        same(M.sari(M.lowered(odd_rows), keys, by, **options), want, by)
        same(M.sari(tokenised, keys, by, **options), want, by)


def test_leaderboard_against_its_metrics(odd_rows):
    keys, by, s = ["i", "system"], ["system"], M.tokenised(odd_rows)
    f = M.token_f1_rows(s, keys).groupBy(by).agg((100 * F.avg("f1")).alias("f1_token"))
    want = M.bleu(s, keys, by).join(M.sari(s, keys, by), by).join(M.corpus_fkgl(odd_rows, "sys", by), by).join(f, by)
    same(M.leaderboard(odd_rows, ["i"]), want.select("system", *(F.round(c, 2).alias(c) for c in ("bleu", "sari", "fkgl", "f1_token"))), by)


def test_chosen_baselines(odd_rows):
    texts = odd_rows.drop("system")
    every = M.baselines(texts)
    for some in (M.SYSTEMS[:3], M.SYSTEMS[3:]):
        assert M.baselines(texts, some).exceptAll(every.where(F.col("system").isin(*some))).count() == 0
        assert M.baselines(texts, some).count() == every.where(F.col("system").isin(*some)).count() > 0
        a, b = M.baselines(texts, some, low=True), M.lowered(M.baselines(texts, some))
        assert a.exceptAll(b.select(a.columns)).count() == 0


def test_turn_runs_are_turns(spark, tmp_path):
    """Long conversations, gaps, repeated turns, turns below zero, nulls."""
    r = random.Random(5)
    rows = [(c, t, "user", None if r.random() < 0.05 else f"{c} {t} {r.random()}") for c in range(9) for t in range(-40, 90) for _ in range(r.choice([0, 1, 1, 1, 1, 1, 1, 2]))]
    rows += [(None, t, "user", f"none {t}") for t in range(30)] + [(c, None, "user", f"lost {c}") for c in range(3)]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    for n in (2, 4):
        a, b = turns(spark, path, n), turn_runs(spark, path, n)
        assert a.schema == b.schema and a.count() == b.count() > 100 and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("query", [P.baselines_leaderboard, P.sari_relative_window, P.reference_row])
def test_no_row_a_gram(spark, data, query):
    """Of tokens and grams no rows are made: only turns and systems are."""
    plan = query(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") <= 3 and plan.count("ArrowEvalPython") == 1
