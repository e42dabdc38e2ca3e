import pytest
from pyspark.sql import functions as F

from prosemeter.functions import buckets as B
from prosemeter.functions import text as T
from prosemeter.functions import words as W


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_13a(spark):
    text = "He paid $3.5, i.e. 1-2 {x} & it's &quot;ok&quot;."
    assert one(spark, T.normalize(F.lit(text))) == 'he paid $ 3.5 , i . e . 1 - 2 { x } & it\'s " ok " .'


@pytest.mark.parametrize("word,n", [("the", 1), ("idea", 2), ("science", 1), ("be", 0), ("see", 0), ("60", 2), ("nation", 2), ("quietly", 3), (".", 0), ("", 0), ("THE", 1), ("etc", 4)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables(F.lit(word))) == n


def test_sentences(spark):
    assert one(spark, T.stop_sentences(F.lit(" One. Two!? three \n"))) == ["One", "Two", "three"]
    assert one(spark, T.stop_sentences(F.lit("..."))) == []
    assert one(spark, T.dot_sentences(F.lit("a. b! c."))) == ["a", "b! c"]
    assert one(spark, T.lookbehind_sentences(F.lit("a. b!  c 3.5 d"))) == ["a.", "b!", "c 3.5 d"]
    assert one(spark, T.boundary_sentences(F.array(F.lit("a"), F.lit("."), F.lit("b"), F.lit(".")))) == 2
    assert one(spark, T.words(F.lit(None).cast("string"))) is None
    assert one(spark, T.words(F.lit("   \n\t"))) == []


def test_small_functions(spark):
    assert one(spark, T.canonical(F.lit("U.S.-a"))) == "USa"
    assert one(spark, T.canonical(F.lit("."))) == "."
    assert one(spark, T.is_acronym(F.lit("U.N."), F.lit("United  Nations")))
    assert one(spark, T.html_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&#x27;&quot;&gt;"
    assert one(spark, T.preview(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, T.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, T.fill_template(F.lit("{a}-{b}"), a=F.lit("1"), b=F.lit("2"))) == "1-2"
    assert one(spark, T.retryable(F.lit("Error 503: slow down"))) and not one(spark, T.retryable(F.lit("Error 429: slow down")))
    assert one(spark, T.retryable(F.lit("Error 429: slow down"), T.RETRYABLE_QA))
    assert not one(spark, T.retryable(F.lit(None).cast("string")))
    assert not one(spark, T.retryable(F.lit("500"), T.RETRYABLE_QA))
    assert one(spark, T.safe_divide(F.lit(1.0), F.lit(0.0))) == 0


@pytest.mark.parametrize("score,label", [(-1.0, "Evaluation failed"), (8.0, "Very simple (elementary level)"), (12.1, "Moderately simple (high school level)"), (16.5, "Not simple (college level or above)")])
def test_fkgl_label(spark, score, label):
    assert one(spark, B.fkgl_label(F.lit(score))) == label


def test_vividness(spark):
    v = B.vividness(F.lit(0.26378047986066183), F.lit(0.271), F.lit(0.5984126984126984))
    assert one(spark, v) == pytest.approx(0.3663360014680742, abs=1e-12)
    with pytest.raises(ValueError):
        B.vividness(F.lit(0), F.lit(0), F.lit(0), (0.5, 0.5, 0.5))
    assert one(spark, B.decorative_intensity(F.lit(0.05))) == pytest.approx(0.2)
    assert one(spark, B.decorative_intensity(F.lit(0.9))) == 1.0


def test_lcs():
    assert W.lcs_pairs("a b c d".split(), "b x d a".split()) == [(1, 0), (3, 2)]
    assert W.lcs_pairs([], ["a"]) == []
    import itertools

    for n in range(4):
        for a in itertools.product("ab", repeat=n):
            for b in itertools.product("ab", repeat=3):
                best = max(k for k in range(4) for c in itertools.combinations(range(n), k) if _sub([a[i] for i in c], b))
                assert len(W.lcs_pairs(list(a), list(b))) == best


def _sub(x, y):
    it = iter(y)
    return all(c in it for c in x)


def test_edit_distance(spark):
    import random

    draw = random.Random(3)
    texts = ["", "a", "abc", None, "kitten", "sitting", "flaw", "lawn", *("".join(draw.choices("abcé\U0001d11e ", k=draw.randint(0, 90))) for _ in range(120))]
    pairs = [(draw.choice(texts), draw.choice(texts)) for _ in range(400)] + [("abc" * 2000, "bca" * 1900)]
    got = spark.createDataFrame(pairs, "a string, b string").select(W.levenshtein("a", "b").alias("own"), F.levenshtein("a", "b").alias("spark"))
    assert got.where("not own <=> spark").count() == 0
    assert W.edit_distances([("kitten", "sitting"), ("", ""), ("é", ""), ("\ud800a", "a")]) == [3, 0, 1, 1]
    long = ["".join(draw.choices("abc ", k=n)) for n in (4097, 4200, 64, 65, 63, 128, 4096)]
    assert W.edit_distances([(x, y) for x in long for y in long]) == [W._distance(x, y) if x != y else 0 for x in long for y in long]


def test_shared_tokens(spark):
    rows = [(["a", "b", "a", "a"], ["a", "c", "a"]), ([], ["a"]), (None, ["a"]), (["a", None], [None, "b"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(W.shared_tokens("a", "b").alias("n")).collect()
    assert [r.n for r in got] == [2, 0, None, 1]


def test_runs_and_alignment():
    assert W.common_runs("a b c x y".split(), "x y a b c".split()) == [(0, 2, 3), (3, 0, 2)]
    assert (0, 0) in W.align_words("cats sat on the mat .".split(), "cat sat .".split())
    assert W.relatedness("U.S.", "US") == 1.0
    assert W.relatedness("12", "13") == 0.0
    assert W.relatedness("big", "large", frozenset({("big", "large")})) == 0.9
    assert W.sentence_groups([(0, 0), (0, 1), (1, 2), (2, 2), (2, 3)]) == [([0], [0, 1]), ([1, 2], [2]), ([2], [3])] or W.sentence_groups([(0, 0), (0, 1)]) == [([0], [0, 1])]


def test_edit_labels():
    a, b = "the big cat sat".split(), "the cat sat down".split()
    assert W.edit_labels(a, b, W.lcs_pairs(a, b)) == (["C", "D", "C", "C"], ["C", "C", "C", "A"])
    a, b = "x y z".split(), "x w z".split()
    assert W.edit_labels(a, b, W.lcs_pairs(a, b)) == (["C", "R", "C"], ["C", "R", "C"])
    assert W.edit_labels(["a", "b"], ["b", "a"], [(0, 1), (1, 0)])[0].count("M") == 1
    assert W.outside_lcs(["a", "b"], ["b"]) == "<b>a</b> b"


def test_scene_arithmetic():
    full = {"relation": True, "participants": [True]}
    assert W.samsa_score([full, full], 2) == 1.0
    assert W.samsa_score([full, full], 1) == 0.5
    assert W.samsa_score([full], 2) == 0.0
    assert W.samsa_score([], 1) == 0.0
    assert W.match_scenes([[3, 1], [5, 4]]) == [1, 0]
    assert W.match_scenes([[3], [5]]) == [0, 0]
    edges = {"s": [("A", "x"), ("P", "p")], "p": [("C", "c1"), ("C", "c2")]}
    assert W.minimal_centres(edges, "s") == ["c1", "c2"]
