"""Per-document scores. Each takes a table and the name of its text column and adds columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemeter.functions import buckets as B
from prosemeter.functions import text as T
from prosemeter.operators.simplification import fkgl


def readability(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_sentences, n_words, n_syllables, fkgl (-1 without a sentence) and its label."""
    c = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({"n_sentences": F.size(T.stop_sentences(c)).cast("long"), "__w": T.words(T.pieces_text(c))})
    counted = counted.withColumns({"n_words": F.size("__w").cast("long"), "n_syllables": T.syllables_of(F.col("__w"))}).drop("__w")
    scored = counted.withColumn("fkgl", F.when(F.col("n_sentences") == 0, -1.0).otherwise(fkgl(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables"))))
    return scored.withColumn("fkgl_label", B.fkgl_label(F.col("fkgl")))


def _word_sums(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, n_sentences, n_words, n_syllables, n): sums over rows, by words as rows.

    Words are scored in generated code and summed before the exchange, which carries one row a group
    and task; several times faster than lambdas over arrays.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    w = docs.select(*by, F.size(T.stop_sentences(c)).alias("s"), T.words(T.pieces_text(c)).alias("w"))
    long = w.select(*by, "s", F.posexplode_outer("w").alias("i", "word")).withColumn("stem", T.stem_of(F.col("word")))
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return long.groupBy(*by).agg(zero(F.when(first, F.col("s"))).alias("n_sentences"), F.count("word").alias("n_words"), zero(T.rule_syllables(F.col("word"), F.col("stem"))).alias("n_syllables"), F.count(F.when(first, 1)).alias("n"))


def readability_by_key(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns of `readability` by keys that identify a document (rows that share them are one)."""
    r = _word_sums(docs, keys, text).drop("n")
    scored = r.withColumn("fkgl", F.when(F.col("n_sentences") == 0, -1.0).otherwise(fkgl(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables"))))
    return scored.withColumn("fkgl_label", B.fkgl_label(F.col("fkgl")))


def readability_by_row(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns of `readability` for every row, with `keys`; rows that repeat or lack them stay rows
    of their own, and none gathers in a task."""
    return readability_by_key(docs.withColumn("__row", F.monotonically_increasing_id()), ["__row", *keys], text).drop("__row")


def readability_of(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Corpus FKGL by group: a ratio of sums."""
    sums = _word_sums(docs, by, text).drop("n")
    return sums.withColumn("fkgl", fkgl(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")))


ADJECTIVE = r"(ful|less|ous|ive|able|ible|al|ary|ed|ing)$"
ADVERB = r"(ly|wise|wards)$"


def suffix_tag(word: Column) -> Column:
    return F.when(word.rlike(ADJECTIVE), "JJ").when(word.rlike(ADVERB), "RB").otherwise("NN")


def decorativeness(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_tokens, n_adjectives, n_adverbs, n_decorative_distinct and decorativeness, by the suffix tagger."""
    t = docs.withColumn("__t", T.plain_tokens(F.coalesce(F.col(text), F.lit(""))))
    adj = F.filter("__t", lambda w: w.rlike(ADJECTIVE))
    adv = F.filter("__t", lambda w: ~w.rlike(ADJECTIVE) & w.rlike(ADVERB))
    t = t.withColumns({"n_tokens": F.size("__t"), "n_adjectives": F.size(adj), "n_adverbs": F.size(adv), "n_decorative_distinct": F.size(F.array_distinct(F.filter("__t", lambda w: w.rlike(ADJECTIVE) | w.rlike(ADVERB))))}).drop("__t")
    n = F.col("n_adjectives") + F.col("n_adverbs")
    share = F.when(F.col("n_tokens") > 0, n / F.col("n_tokens")).otherwise(0.0)
    diversity = F.when(n > 0, F.col("n_decorative_distinct") / n).otherwise(0.0)
    score = F.least(F.lit(1.0), 0.6 * F.least(B.decorative_intensity(share), F.lit(1.0)) + 0.4 * diversity)
    return t.withColumn("decorativeness", score)


def mean_of_means(docs: DataFrame, keys: list[str], word_score: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """(keys, score): words (two letters or more, alphabetic) scored, averaged by sentence (0
    without words), then by document. All in the row; nothing is shuffled."""
    def sentence(s: Column) -> Column:
        ws = F.filter(T.split_words(T.squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))), lambda w: (F.length(w) >= 2) & T.alphabetic(w))
        total = F.aggregate(F.transform(ws, word_score), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(ws) > 0, total / F.greatest(F.size(ws), F.lit(1))).otherwise(0.0)

    scores = F.transform(T.lookbehind_sentences(F.coalesce(F.col(text), F.lit(""))), sentence)
    kept = docs.select(*keys, scores.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return kept.select(*keys, F.when(F.size("s") > 0, total / F.greatest(F.size("s"), F.lit(1))).otherwise(0.0).alias("score"))


def lexicon_level(docs: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, level, min_level, max_level, n_found): mean vocabulary level.

    lexicon: (word, pos, level); the level of a word is that of its (word, suffix tag), else the
    mean over its tags; unknown words are skipped. Spark broadcasts the lexicon if its size allows.
    """
    w = docs.select(*keys, F.explode(T.plain_tokens(F.col(text))).alias("word")).where(T.alphabetic(F.col("word")))
    w = w.groupBy(*keys, "word").agg(F.count("*").alias("c")).withColumn("pos", suffix_tag(F.col("word")))
    exact = lexicon.select("word", "pos", F.col("level").alias("exact"))
    mean = lexicon.groupBy("word").agg(F.avg("level").alias("mean"))
    found = w.join(mean, "word").join(exact, ["word", "pos"], "left").withColumn("level", F.coalesce("exact", "mean"))
    return found.groupBy(*keys).agg((F.sum(F.col("level") * F.col("c")) / F.sum("c")).alias("level"), F.min("level").alias("min_level"), F.max("level").alias("max_level"), F.sum("c").alias("n_found"))


def level_summary(levels: DataFrame, of: dict) -> DataFrame:
    """A corpus figure from documents' `level`: average, least and greatest with their names by `of`
    (a bucket table), all texts and those with a level."""
    named = lambda c: F.when(F.col(c).isNotNull(), B.bucket(F.round(c, 9), of))
    one = levels.agg(F.avg("level").alias("average_level"), F.min("level").alias("min_level"), F.max("level").alias("max_level"), F.count("*").alias("total_texts"), F.count("level").alias("valid_texts"))
    return one.withColumns({f"{c}_name": F.coalesce(named(c), F.lit("N/A")) for c in ("average_level", "min_level", "max_level")})


def lexicon_share(docs: DataFrame, scores: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, positive, negative, emotionality): shares of positive and negative lexicon weight.

    A stand-in for a sentiment analyser; scores: (word, valence in [-1, 1]).
    """
    w = docs.select(*keys, F.explode_outer(T.plain_tokens(F.col(text))).alias("word")).join(scores, "word", "left")
    v = F.coalesce(F.col("valence"), F.lit(0.0))
    sums = w.groupBy(*keys).agg(F.sum(F.greatest(v, F.lit(0.0))).alias("p"), F.sum(F.greatest(-v, F.lit(0.0))).alias("q"), F.sum(F.when(F.coalesce("valence", F.lit(0.0)) == 0, 1).otherwise(0)).alias("z"))
    whole = F.greatest(F.col("p") + F.col("q") + F.col("z"), F.lit(1e-12))
    return sums.select(*keys, (F.col("p") / whole).alias("positive"), (F.col("q") / whole).alias("negative"), ((F.col("p") + F.col("q")) / whole).alias("emotionality"))


def compare(a: str, b: str, lower_wins: bool = False) -> Column:
    """Which of two scores wins; a tie goes to text_2."""
    wins = F.col(a) < F.col(b) if lower_wins else F.col(a) > F.col(b)
    return F.when(wins, "text_1").otherwise("text_2")


#: Fixed values below: how a comparison words its result.
def compare_vividness(a: Column, b: Column, dead_band: float = 0.05) -> tuple[Column, Column]:
    """(comparison text, winner): the text has a dead band, the winner has none."""
    d = a - b
    shown = F.format_string("%.3f", F.abs(d))
    text = (
        F.when(F.abs(d) < dead_band, "Both texts have similar vividness")
        .when(d > 0, F.concat(F.lit("Text 1 is more vivid than Text 2 (difference: "), shown, F.lit(")")))
        .otherwise(F.concat(F.lit("Text 2 is more vivid than Text 1 (difference: "), shown, F.lit(")")))
    )
    return text, F.when(d > 0, "text1").when(d < 0, "text2").otherwise("tie")
