import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prosemeter.operators import report as R
from prosemeter.operators import simplification as M
from prosemeter.operators import stats as S
from prosemeter.plans import simplification as P
from prosemeter.sources.readers import parallel

ORIG = ["About 95 species are currently accepted.", "The cat perched on the mat."]
SYS = ["About 95 you now get in.", "Cat on mat."]
REFS = [["About 95 species are currently known.", "About 95 species are now accepted.", "95 species are now accepted."], ["The cat sat on the mat.", "The cat is on the mat.", "The cat sat."]]


def frame(spark, orig=ORIG, out=SYS, refs=REFS):
    return spark.createDataFrame(list(zip(range(len(orig)), orig, out, refs)), "row_id long, orig string, sys string, refs array<string>")


def test_sari_golden(spark):
    r = M.sari(M.tokenised(frame(spark)), ["row_id"], []).first()
    assert r["sari"] == pytest.approx(33.17472563619544, abs=1e-9)
    assert (r["add"], r["keep"], r["del"]) == (pytest.approx(6.25), pytest.approx(24.67343976777939), pytest.approx(68.60073714080694))


def test_sari_ignores_reference_order_and_partitions(spark):
    a = M.sari(M.tokenised(frame(spark)), ["row_id"], []).first()
    b = M.sari(M.tokenised(frame(spark, refs=[r[::-1] for r in REFS]).repartition(5)), ["row_id"], []).first()
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)


def test_token_f1(spark):
    one = frame(spark, ["x"], ["the cat sat"], [["the cat sat on it"]])
    f = M.token_f1_rows(M.tokenised(one), ["row_id"]).first()["f1"]
    assert f == pytest.approx(2 * 1 * 0.6 / 1.6)
    same = frame(spark, ["x"], ["a b a"], [["q", "a b a"]])
    assert M.token_f1_rows(M.tokenised(same), ["row_id"]).first()["f1"] == 1.0
    empty = frame(spark, ["x"], [""], [["a"]])
    assert M.token_f1_rows(M.tokenised(empty), ["row_id"]).first()["f1"] == 0.0


def test_bleu(spark):
    same = frame(spark, ORIG, ORIG, [[o] for o in ORIG])
    assert M.bleu(M.tokenised(same, lowercase=False), ["row_id"], []).first()["bleu"] == pytest.approx(100)
    none = frame(spark, ["a"], ["zz"], [["b c d e"]])
    assert M.bleu(M.tokenised(none), ["row_id"], []).first()["bleu"] == 0.0
    # one of two words right, order 2 smoothed by floor: exp(mean(log 50, log 10))
    half = frame(spark, ["a"], ["x y"], [["x z"]])
    got = M.bleu(M.tokenised(half), ["row_id"], ["row_id"], smooth="floor", effective=True).first()["bleu"]
    assert got == pytest.approx((50 * 10) ** 0.5)
    short = frame(spark, ["a"], ["a b c d"], [["a b c d e f"]])
    assert M.bleu(M.tokenised(short), ["row_id"], []).first()["bleu"] == pytest.approx(100 * 2.718281828459045 ** (1 - 6 / 4))


def test_baselines(spark):
    rows = {r["system"]: r for r in M.baselines(frame(spark)).where("row_id = 1").collect()}
    assert rows["Truncate baseline"]["sys"] == "The cat perched on."
    assert rows["Identity baseline"]["sys"] == ORIG[1]
    assert rows["Reference*"]["refs"] == [REFS[1][1], REFS[1][1], REFS[1][2]]
    assert {r["system"] for r in M.baselines(frame(spark, refs=[["a"], ["b"]])).collect()} == {"system", "Identity baseline", "Truncate baseline"}


def test_quality_features(spark):
    r = M.quality_features(frame(spark, ["a b c"], ["a b d"], [["x"]])).first()
    assert (r["compression"], r["exact"], r["additions"], r["deletions"]) == (1.0, 0.0, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_empty_and_null(spark):
    r = frame(spark, ["", None], ["", "a"], [["x"], ["y"]])
    assert M.sari(M.tokenised(r), ["row_id"], []).count() == 1
    none = frame(spark).where("row_id > 9")
    assert M.sari_stats(M.gram_counts(M.tokenised(none), ["row_id"]), []).count() == 0


def test_length_limits(spark):
    rows = spark.createDataFrame([(i,) for i in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]], "n int")
    got = [tuple(r) for r in S.length_limits(rows, F.col("n")).orderBy("bin").collect()]
    assert got == [(0, 1, 1), (1, 1, 2), (2, 2, 4), (3, 4, 6), (4, 6, 8)]


def test_report(spark):
    d = R.description(frame(spark)).first()
    assert (d["n_samples"], d["n_refs"], d["one_to_one"]) == (2, 3, 100.0)
    lists = R.ranked_samples(frame(spark), ["row_id"], 1)
    assert lists["best SARI"].first()["sari"] >= lists["worst SARI"].first()["sari"]
    assert len(lists) == 6


#: Folder of the public corpora (test_sets, system_outputs), where there is one.
CORPORA = os.environ.get("PROSEMETER_CORPORA", "")


@pytest.mark.skipif(not os.path.isdir(CORPORA), reason="public corpora are not here")
@pytest.mark.parametrize("system,score,legacy", [("turkcorpus/test/tok.low/Dress-Ls.tok.low", 37.266058818588216, True), ("turkcorpus/test/ACCESS", 41.381013, False)])
def test_corpus_goldens(spark, system, score, legacy):
    out = f"{CORPORA}/system_outputs/{system}"
    if not os.path.exists(out):
        pytest.skip("no such output here")
    t = f"{CORPORA}/test_sets/turkcorpus"
    src, ref = (f"{t}/legacy/test.8turkers.tok.norm", "legacy/test.8turkers.tok.turk.") if legacy else (f"{t}/test.truecase.detok.orig", "test.truecase.detok.simp.")
    rows = parallel(spark, src, [f"{t}/{ref}{i}" for i in range(8)], {"s": out})
    got = M.sari(M.tokenised(rows, legacy=legacy), ["row_id"], []).first()["sari"]
    assert got == pytest.approx(score, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(CORPORA), reason="public corpora are not here")
def test_fkgl_goldens(spark):
    t = f"{CORPORA}/test_sets/turkcorpus/legacy"
    rows = parallel(spark, f"{t}/test.8turkers.tok.norm", [f"{t}/test.8turkers.tok.turk.0"], {"ref": f"{t}/test.8turkers.tok.turk.0"})
    assert M.corpus_fkgl(rows, "orig", []).first()[0] == pytest.approx(9.9, abs=0.1)
    assert M.corpus_fkgl(rows, "sys", []).first()[0] == pytest.approx(8.2, abs=0.1)


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_quality_estimation_takes_whole_turns(spark, tmp_path):
    """Turns that agree in their first 400 characters only, against brute force."""
    start = "the cat sat on the mat " * 20
    pairs = [(start + "and then the dog ran", start + "but the cat slept on " * 9), (start + "a b a", start + "a b a"), ("a a b c", "a c c d")]
    path = f"file://{tmp_path}"
    spark.createDataFrame([(c, t, "user", x.strip()) for c, p in enumerate(pairs) for t, x in enumerate(p)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    want = Counter()
    for o, s in [(o.strip(), s.strip()) for o, s in pairs]:
        ow, sw = Counter(o.split()), Counter(s.split())
        n = max(ow.total(), sw.total())
        want += Counter(compression=len(s) / len(o), edit_similarity=1 - _edit_distance(o, s) / max(len(o), len(s)), exact=float(o == s), additions=(sw - ow).total() / n, deletions=(ow - sw).total() / n)
    got = P.quality_estimation(spark, path).first()
    assert {c: got[c] for c in want} == {c: pytest.approx(x / len(pairs), abs=1e-6) for c, x in want.items()}
