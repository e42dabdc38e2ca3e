"""Readability and vividness of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemeter.functions import buckets as B
from prosemeter.functions import text as T
from prosemeter.operators import documents as D
from prosemeter.operators import stats as S
from prosemeter.operators.simplification import fkgl
from prosemeter.plans import duck
from prosemeter.plans.common import Query, rounded, texts

LEXICON = (("the", "NN", 0.5), ("and", "NN", 0.6), ("of", "NN", 0.7), ("thing", "JJ", 2.0), ("thing", "NN", 3.0), ("heiten", "NN", 4.0), ("que", "NN", 1.5), ("de", "NN", 1.0), ("tion", "NN", 3.5), ("ering", "JJ", 5.5))
VALENCE = (("the", 0.1), ("and", -0.2), ("que", 0.5), ("von", -0.4), ("of", 0.3))


def fkgl_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.readability_by_row(texts(spark, sf_dir), ["doc_id"]))


def fkgl_corpus_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.readability_of(texts(spark, sf_dir), ["source"]))


def fkgl_side_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = texts(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    r = D.readability(sides.select("role", "text"))
    sums = r.rollup("role").agg(*(F.sum(c).alias(c) for c in ("n_sentences", "n_words", "n_syllables")), F.count("*").alias("n"))
    scored = sums.withColumn("fkgl", fkgl(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")))
    return rounded(scored.select(F.coalesce("role", F.lit("all")).alias("side"), "n", "fkgl", B.bucket(F.col("fkgl"), B.FKGL_LEVEL, True).alias("level")))


def fkgl_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = texts(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    r = D.readability_of(sides, ["role"])
    one = r.agg(F.max(F.when(F.col("role") == "user", F.col("fkgl"))).alias("user_fkgl"), F.max(F.when(F.col("role") == "assistant", F.col("fkgl"))).alias("assistant_fkgl"))
    gap = F.abs(F.col("user_fkgl") - F.col("assistant_fkgl"))
    return rounded(one.select("*", gap.alias("gap"), B.bucket(gap, B.GAP).alias("assessment")))


def readability_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.readability(texts(spark, sf_dir).select("doc_id", "n_chars", "text"))
    x = F.col("n_chars").cast("double")
    return r.groupBy("fkgl_label", B.ppl_label(x / 10).alias("ppl_label"), B.bucket(x / 1000, B.CEFR).alias("cefr_label"), B.bucket(F.least(x / 5000, F.lit(1.0)), B.VIVIDNESS).alias("vividness_label")).agg(F.count("*").alias("n"))


def tokens_13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = texts(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


def sentence_split_lookbehind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = texts(spark, sf_dir).select("doc_id", T.lookbehind_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.length(F.array_join("s", "|")).alias("n_joined"))


def syllables_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables scored once a distinct word; counts go along, so nothing is joined back."""
    w = texts(spark, sf_dir).select("lang", F.explode(T.words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    w = w.withColumn("stem", T.stem_of(F.col("word")))
    return w.groupBy("lang").agg(F.sum("count").alias("n_words"), F.count("*").alias("n_distinct"), F.sum(T.rule_syllables(F.col("word"), F.col("stem")) * F.col("count")).alias("n_syllables"))


def decorativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.decorativeness(texts(spark, sf_dir).select("doc_id", "text")).drop("text"))


def vividness_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted composite with stand-in components: text length for figurativeness, adverb share for emotionality."""
    d = D.decorativeness(texts(spark, sf_dir).select("doc_id", "text"))
    fig = F.least(F.lit(1.0), F.length("text") / 20000)
    emo = F.least(F.lit(1.0), 5 * F.col("n_adverbs") / F.greatest(F.col("n_tokens"), F.lit(1)))
    v = B.vividness(fig, emo, F.col("decorativeness"))
    out = d.select("doc_id", fig.alias("figurativeness"), emo.alias("emotionality"), "decorativeness", v.alias("vividness"), B.bucket(F.round(v, 9), B.VIVIDNESS).alias("label"), B.bucket(F.round(emo, 9), B.EMOTIONALITY).alias("emotion_label"), B.bucket(F.round("decorativeness", 9), B.DECORATIVENESS).alias("decor_label"), B.bucket(F.round(fig, 9), B.FIGURATIVENESS).alias("figure_label"))
    return rounded(out)


def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.mean_of_means(texts(spark, sf_dir), ["doc_id"], lambda w: F.least(F.lit(1.0), F.length(w) / 20.0)))


def cefr_lexicon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(LEXICON), "word string, pos string, level double")
    scored = D.lexicon_level(texts(spark, sf_dir), lexicon, ["doc_id"])
    return rounded(scored.withColumn("label", B.bucket(F.round("level", 9), B.CEFR)))


def emotion_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spark.createDataFrame(list(VALENCE), "word string, valence double")
    return rounded(D.lexicon_share(texts(spark, sf_dir), scores, ["doc_id"]))


def pairwise_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next by doc_id."""
    docs = texts(spark, sf_dir).select("doc_id", "n_chars", "text")
    s = D.decorativeness(D.readability(docs)).select("doc_id", "n_chars", "fkgl", "decorativeness")
    a = s.select("doc_id", *(F.col(c).alias(f"{c}_1") for c in ("n_chars", "fkgl", "decorativeness")))
    b = s.select((F.col("doc_id") - 1).alias("doc_id"), *(F.col(c).alias(f"{c}_2") for c in ("n_chars", "fkgl", "decorativeness")))
    j = a.join(b, "doc_id")
    said, winner = D.compare_vividness(F.round("decorativeness_1", 9), F.round("decorativeness_2", 9))
    return j.select("doc_id", D.compare("fkgl_1", "fkgl_2", True).alias("fkgl_winner"), D.compare("n_chars_1", "n_chars_2").alias("size_winner"), said.substr(1, 32).alias("comparison"), winner.alias("vividness_winner"))


def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "source", "n_chars", "text")
    s = D.decorativeness(D.readability(docs))
    failed = s.withColumn("coherence", F.when(F.col("doc_id") % 7 == 0, -1.0).otherwise(F.col("n_chars") / 100))
    return rounded(S.metric_statistics(failed, {"fkgl": True, "coherence": True, "decorativeness": False}, ["source"]))


_WORDS = duck.words(duck.pieces_text("coalesce(text, '')"))


def _counts(keys: str, source: str) -> str:
    return f"""w AS (SELECT {keys}, len({duck.stop_sentences("coalesce(text, '')")}) AS n_sentences, {_WORDS} AS ws FROM {source}),
r AS (SELECT {keys}, n_sentences, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda q: {duck.syllables('q')})), 0) AS BIGINT) AS n_syllables FROM w)"""


_FKGL = "CASE WHEN n_words = 0 OR n_sentences = 0 THEN 0.0 ELSE greatest(0.0, 0.39 * (CAST(n_words AS DOUBLE) / n_sentences) + 11.8 * (CAST(n_syllables AS DOUBLE) / n_words) - 15.59) END"
_LABEL = f"CASE WHEN fkgl < 0 THEN 'Evaluation failed' ELSE {B.bucket_sql('fkgl', B.FKGL, True)} END"
_DOC_FKGL = f"CASE WHEN n_sentences = 0 THEN -1.0 ELSE {_FKGL} END"
_PLAIN = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_ADJ, _ADV = f"regexp_matches(z, '{D.ADJECTIVE}')", f"regexp_matches(z, '{D.ADVERB}')"
_DECOR = f"""t AS (SELECT *, {_PLAIN} AS tk FROM documents),
u AS (SELECT * EXCLUDE tk, len(tk) AS n_tokens, len(list_filter(tk, lambda z: {_ADJ})) AS n_adjectives, len(list_filter(tk, lambda z: NOT {_ADJ} AND {_ADV})) AS n_adverbs,
  len(list_distinct(list_filter(tk, lambda z: {_ADJ} OR {_ADV}))) AS n_decorative_distinct FROM t),
v AS (SELECT *, CASE WHEN n_tokens > 0 THEN (n_adjectives + n_adverbs) / CAST(n_tokens AS DOUBLE) ELSE 0.0 END AS x,
  CASE WHEN n_adjectives + n_adverbs > 0 THEN n_decorative_distinct / CAST(n_adjectives + n_adverbs AS DOUBLE) ELSE 0.0 END AS y FROM u),
dec AS (SELECT * EXCLUDE (x, y), least(1.0, 0.6 * least(1.0, CASE WHEN x <= 0.05 THEN x * 4 WHEN x <= 0.15 THEN 0.2 + (x - 0.05) * 3 WHEN x <= 0.30 THEN 0.5 + (x - 0.15) * 2 ELSE least(0.8 + (x - 0.30), 1.0) END) + 0.4 * y) AS decorativeness FROM v)"""
_SENTENCES = f"list_filter(list_transform(string_split({duck.sub(duck.strip('text'), '([.!?])' + duck.WS + '+', chr(92) + '1' + chr(1))}, '{chr(1)}'), lambda z: {duck.strip('z')}), lambda z: z <> '')"
_VALUES = lambda rows: ", ".join("(" + ", ".join(duck.quoted(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows)
_WLIST = r"list_filter(string_split(trim(regexp_replace(z, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda q: length(q) >= 2 AND regexp_matches(q, '^\p{L}+$'))"

QUERIES: dict[str, Query] = {f.__name__: f for f in (fkgl_by_document, fkgl_corpus_by_source, fkgl_side_study, fkgl_gap, readability_buckets, tokens_13a, sentence_split_lookbehind, syllables_distinct_words, decorativeness, vividness_composite, two_level_mean, cefr_lexicon_join, emotion_lexicon, pairwise_compare, metric_statistics)}

SQL: dict[str, str] = {
    "fkgl_by_document": f"WITH {_counts('doc_id', 'documents')}, f AS (SELECT *, {_DOC_FKGL} AS fkgl FROM r) SELECT doc_id, n_sentences, n_words, n_syllables, round(fkgl, 6) AS fkgl, {_LABEL} AS fkgl_label FROM f",
    "fkgl_corpus_by_source": f"WITH {_counts('source', 'documents')}, g AS (SELECT source, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_syllables) AS BIGINT) AS n_syllables FROM r GROUP BY source) SELECT *, round({_FKGL}, 6) AS fkgl FROM g",
    "fkgl_side_study": f"""WITH {_counts('role', "(SELECT * FROM conversations WHERE role IN ('user', 'assistant')) c")}, g AS (SELECT role, sum(n_sentences) AS n_sentences, sum(n_words) AS n_words, sum(n_syllables) AS n_syllables, count(*) AS n FROM r GROUP BY ROLLUP (role)),
f AS (SELECT coalesce(role, 'all') AS side, n, {_FKGL} AS fkgl FROM g) SELECT side, n, round(fkgl, 6) AS fkgl, {B.bucket_sql('fkgl', B.FKGL_LEVEL, True)} AS level FROM f""",
    "fkgl_gap": f"""WITH {_counts('role', "(SELECT * FROM conversations WHERE role IN ('user', 'assistant')) c")}, g AS (SELECT role, sum(n_sentences) AS n_sentences, sum(n_words) AS n_words, sum(n_syllables) AS n_syllables FROM r GROUP BY role),
f AS (SELECT role, {_FKGL} AS fkgl FROM g), o AS (SELECT max(CASE WHEN role = 'user' THEN fkgl END) AS a, max(CASE WHEN role = 'assistant' THEN fkgl END) AS b FROM f)
SELECT round(a, 6) AS user_fkgl, round(b, 6) AS assistant_fkgl, round(abs(a - b), 6) AS gap, {B.bucket_sql('abs(a - b)', B.GAP)} AS assessment FROM o""",
    "readability_buckets": f"""WITH {_counts('doc_id, n_chars', 'documents')}, f AS (SELECT CAST(n_chars AS DOUBLE) AS x, {_DOC_FKGL} AS fkgl FROM r)
SELECT {_LABEL} AS fkgl_label, {B.bucket_sql('x / 10', B.PPL)} AS ppl_label, {B.bucket_sql('x / 1000', B.CEFR)} AS cefr_label, {B.bucket_sql('least(x / 5000, 1.0)', B.VIVIDNESS)} AS vividness_label, count(*) AS n FROM f GROUP BY ALL""",
    "tokens_13a": f"WITH w AS (SELECT doc_id, {duck.words('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM w",
    "sentence_split_lookbehind": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, length(array_to_string(s, '|')) AS n_joined FROM s",
    "syllables_distinct_words": f"WITH w AS (SELECT lang, unnest({duck.words('text')}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS c FROM w GROUP BY ALL) SELECT lang, CAST(sum(c) AS BIGINT) AS n_words, count(*) AS n_distinct, CAST(sum(({duck.syllables('word')}) * c) AS BIGINT) AS n_syllables FROM c GROUP BY lang",
    "decorativeness": f"WITH {_DECOR} SELECT doc_id, n_tokens, n_adjectives, n_adverbs, n_decorative_distinct, round(decorativeness, 6) AS decorativeness FROM dec",
    "vividness_composite": f"""WITH {_DECOR}, e AS (SELECT doc_id, least(1.0, length(text) / 20000.0::DOUBLE) AS fig, least(1.0, 5 * n_adverbs / CAST(greatest(n_tokens, 1) AS DOUBLE)) AS emo, decorativeness AS d FROM dec),
f AS (SELECT *, 0.4 * fig + 0.3 * emo + 0.3 * d AS v FROM e)
SELECT doc_id, round(fig, 6) AS figurativeness, round(emo, 6) AS emotionality, round(d, 6) AS decorativeness, round(v, 6) AS vividness, {B.bucket_sql('round(v, 9)', B.VIVIDNESS)} AS label, {B.bucket_sql('round(emo, 9)', B.EMOTIONALITY)} AS emotion_label, {B.bucket_sql('round(d, 9)', B.DECORATIVENESS)} AS decor_label, {B.bucket_sql('round(fig, 9)', B.FIGURATIVENESS)} AS figure_label FROM f""",
    "two_level_mean": f"""WITH s AS (SELECT doc_id, list_transform({_SENTENCES}, lambda z: list_aggregate(list_transform({_WLIST}, lambda q: least(1.0, length(q) / 20.0::DOUBLE)), 'avg')) AS m FROM documents)
SELECT doc_id, round(coalesce(list_aggregate(list_transform(m, lambda z: coalesce(z, 0.0)), 'avg'), 0.0), 6) AS score FROM s""",
    "cefr_lexicon_join": f"""WITH lex(word, pos, level) AS (VALUES {_VALUES(LEXICON)}),
w AS (SELECT doc_id, unnest({_PLAIN}) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS c, CASE WHEN regexp_matches(word, '{D.ADJECTIVE}') THEN 'JJ' WHEN regexp_matches(word, '{D.ADVERB}') THEN 'RB' ELSE 'NN' END AS pos FROM w WHERE regexp_matches(word, '^\\p{{L}}+$') GROUP BY ALL),
m AS (SELECT word, avg(level) AS mean FROM lex GROUP BY word),
f AS (SELECT doc_id, c, coalesce(lex.level, m.mean) AS level FROM c JOIN m USING (word) LEFT JOIN lex ON lex.word = c.word AND lex.pos = c.pos),
g AS (SELECT doc_id, sum(level * c) / sum(c) AS l, min(level) AS a, max(level) AS b, CAST(sum(c) AS BIGINT) AS n FROM f GROUP BY doc_id)
SELECT doc_id, round(l, 6) AS level, round(a, 6) AS min_level, round(b, 6) AS max_level, n AS n_found, {B.bucket_sql('round(l, 9)', B.CEFR)} AS label FROM g""",
    "emotion_lexicon": f"""WITH lex(word, valence) AS (VALUES {_VALUES(VALENCE)}), w AS (SELECT doc_id, unnest({_PLAIN}) AS word FROM documents),
a AS (SELECT doc_id, word FROM w UNION ALL SELECT doc_id, NULL FROM documents WHERE len({_PLAIN}) = 0),
g AS (SELECT doc_id, sum(greatest(coalesce(valence, 0), 0)) AS p, sum(greatest(-coalesce(valence, 0), 0)) AS q, sum(CASE WHEN coalesce(valence, 0) = 0 THEN 1 ELSE 0 END) AS z FROM a LEFT JOIN lex USING (word) GROUP BY doc_id)
SELECT doc_id, round(p / (p + q + z), 6) AS positive, round(q / (p + q + z), 6) AS negative, round((p + q) / (p + q + z), 6) AS emotionality FROM g""",
    "pairwise_compare": f"""WITH {_counts('doc_id, n_chars', 'documents')}, f AS (SELECT doc_id, n_chars, {_DOC_FKGL} AS fkgl FROM r), {_DECOR}, s AS (SELECT f.*, round(dec.decorativeness, 9) AS d FROM f JOIN dec USING (doc_id))
SELECT a.doc_id, CASE WHEN a.fkgl < b.fkgl THEN 'text_1' ELSE 'text_2' END AS fkgl_winner, CASE WHEN a.n_chars > b.n_chars THEN 'text_1' ELSE 'text_2' END AS size_winner,
substr(CASE WHEN abs(a.d - b.d) < 0.05 THEN 'Both texts have similar vividness' WHEN a.d > b.d THEN 'Text 1 is more vivid than Text 2 (difference: ' ELSE 'Text 2 is more vivid than Text 1 (difference: ' END, 1, 32) AS comparison,
CASE WHEN a.d > b.d THEN 'text1' WHEN a.d < b.d THEN 'text2' ELSE 'tie' END AS vividness_winner FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
    "metric_statistics": f"""WITH {_counts('doc_id, source, n_chars', 'documents')}, f AS (SELECT *, {_DOC_FKGL} AS fkgl FROM r), {_DECOR},
l AS (SELECT source, 'fkgl' AS metric, fkgl AS value FROM f WHERE fkgl >= 0 UNION ALL SELECT source, 'coherence', n_chars / 100.0::DOUBLE FROM f WHERE doc_id % 7 <> 0 UNION ALL SELECT source, 'decorativeness', decorativeness FROM dec)
SELECT source, metric, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS count FROM l GROUP BY ALL""",
}
