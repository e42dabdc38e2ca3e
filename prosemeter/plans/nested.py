"""Key facts, replies, sections, requests and figures over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemeter.functions import text as T
from prosemeter.functions import words as W
from prosemeter.operators import annotation as A
from prosemeter.operators import evaluation as E
from prosemeter.operators import exchange as X
from prosemeter.operators import nested as N
from prosemeter.operators import stats as S
from prosemeter.operators import windows as Wd
from prosemeter.plans import duck
from prosemeter.plans.common import Query, rounded, table, texts, turns, turns_sql
from prosemeter.plans.readability import _DECOR, _DOC_FKGL, _counts

REPLIES = (
    (1, "Coherence: 4.5 - reads well"), (1, "I would say 3"), (1, "no number"), (2, "Coherence: 2"), (2, "score 7 of 9"), (3, "nothing here"), (4, "Coherence:5"), (4, "5"),
)
SCORE_REPLIES = (
    (1, 3, '{"scores":[10,9,0]}'), (2, 3, '{"scores":[10,9]}'), (3, 2, '```json\n{"scores": [1, 2]}\n```'), (4, 2, 'so "scores" : [ 4, 5 ] it is'),
    (5, 2, '[{"index": 0, "score": 7}, {"index": 1, "score": 8}, {"index": 0, "score": 6}]'), (6, 2, '{"scores":[11,2]}'), (7, 2, "none"),
)
FACT_REPLIES = (
    (1, '[{"entity":"a","behavior":"b","context":"c","priority":1}]'), (2, '{"keyfacts":[{"entity":"a","behavior":"b","context":null,"priority":2},{"entity":"d","behavior":"e","context":"f","priority":3}]}'),
    (3, '{"key_facts":[]}'), (4, '{"note":"x","facts":[{"entity":"z","behavior":"y","context":"w","priority":1}]}'), (5, '{"note":"x"}'),
)
_G, _T = '{"entity":"g%d","behavior":"b","context":"c","priority":1}', '{"entity":"t%d","behavior":"b","context":"c","priority":1}'
PAIR_REPLIES = (
    (1, 0, f"[[{_G % 1},{_T % 1}],[{_G % 2},{_T % 2}]]"), (2, 0, f"[[[{_G % 1},{_T % 1}]],[[{_G % 2},{_T % 2}]]]"), (3, 0, f"[[[[{_G % 1},{_T % 1}]],[[{_G % 1},{_T % 2}]]]]"), (4, 0, "[]"),
)
QUIZ = (
    (1, ["a", "B ", "c"], ["A", "b", "d"]), (2, ["a"], ["a", "b"]), (3, [], []), (4, ["x", "y"], [" X", "Y "]),
)
WIKI = (
    (1, "lead text\n== One ==\nfirst\n== Two ==\nsecond"), (2, "only lead"), (3, "\n== A ==\n== B ==\nbody"), (4, "== Start ==\nbody\n=== Sub ===\nmore"), (5, "  "), (6, "x\n== E ==\n\n== F ==\ny"),
)
NAMES = {"PERSON@1": "Ann Lee", "LOC@1": "Rome"}


def keyfact_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a turn as facts of the next one's: priority by length."""
    p = turns(spark, sf_dir, 2)
    facts = lambda c: p.select("conv_id", "turn", F.explode(F.array_distinct(T.plain_tokens(F.col(c)))).alias("entity")).select("*", F.lit("said").alias("behavior"), (1 + F.length("entity") % 3).alias("priority"))
    return rounded(N.matched_scores(facts("t1"), facts("t0"), ["conv_id", "turn"]))


def keyfact_wrapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(FACT_REPLIES), "id int, reply string")
    return rows.select("id", F.size(N.facts_from_json(F.col("reply"))).alias("n_facts"), F.array_join(F.transform(N.facts_from_json(F.col("reply")), lambda f: F.concat_ws(":", f["entity"], f["priority"].cast("string"))), ",").alias("facts"))


def keyfact_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = "array<struct<entity:string,behavior:string,context:string,priority:int>>"
    ids = spark.createDataFrame([(i,) for i, *_ in PAIR_REPLIES], "id int")
    three = lambda s: ids.select("id", F.expr(f"from_json('[{','.join(s % k for k in (1, 2, 3))}]', '{fact}')").alias("facts"))
    pairs = spark.createDataFrame(list(PAIR_REPLIES), "id int, group int, reply string")
    return rounded(N.alignment_scores(three(_G), three(_T), pairs, ["id"]))


def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(QUIZ), "id int, right array<string>, answers array<string>")
    return rounded(rows.select("id", N.mcq_accuracy(F.transform("right", lambda a: F.struct(a.alias("answer"))), F.col("answers")).alias("score")))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.judged(spark.createDataFrame(list(REPLIES), "doc_id int, reply string"), ["doc_id"]))


def score_reply_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(SCORE_REPLIES), "id int, n int, reply string")
    return rows.select("id", F.array_join(N.parse_scores(F.col("reply"), F.col("n")).cast("array<string>"), ",").alias("scores"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(WIKI), "id int, text string")
    s = rows.select("id", F.posexplode(N.previews(N.sections(F.col("text")), 6)).alias("pos", "s"))
    return s.select("id", "pos", F.coalesce("s.heading", F.lit("-")).alias("heading"), F.col("s.content_preview").alias("content"))


def request_response_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for all items; every third response is missing, every fifth failed, some came twice."""
    items = table(spark, sf_dir, "benchmark")
    asked = X.requests(items, F.concat(F.lit("bench:"), F.col("item_id")), F.concat(F.lit("Rate: "), "text"), "judge")
    came = items.where("item_id % 3 <> 0").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("try")).where("try = 1 or item_id % 2 = 0")
    body = F.struct(F.array(F.struct(F.struct(F.concat_ws(" ", F.lit("reply"), "item_id", "try").alias("content")).alias("message"))).alias("choices"))
    responses = came.select(F.concat(F.lit("bench:"), F.col("item_id")).alias("custom_id"), "try", F.struct(F.when(F.col("item_id") % 5 == 0, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response"))
    done = X.merged(asked, X.latest(responses, "custom_id", ["try"]), strict=False)
    return done.select("custom_id", F.length(F.col("body.messages")[0]["content"]).alias("prompt_length"), "reply", "problem")


def ppl_side_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.study_statistics(table(spark, sf_dir, "events"), "value", ["event_type"]))


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("guess"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("fold", (F.col("doc_id") % 5).cast("int"))


def binary_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.binary_figures(_guesses(spark, sf_dir), "quality", "guess"))


def fold_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = S.binary_figures(_guesses(spark, sf_dir), "quality", "guess", ["fold"])
    return rounded(S.fold_means(folds, ["accuracy", "precision", "recall", "f1"]))


def lcs_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turns(spark, sf_dir, 2).select("conv_id", "turn", T.words(F.col("t0")).alias("a"), T.words(F.col("t1")).alias("b"))
    return p.select("conv_id", "turn", F.size(W.lcs("a", "b")).alias("n_common"))


def edit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit labels against the next turn, judged against those of the two turns after."""
    p = turns(spark, sf_dir, 4).select("conv_id", "turn", *(T.words(F.col(f"t{i}")).alias(f"w{i}") for i in range(4)))
    ops = p.select("conv_id", "turn", *(W.edit_operations("w0", f"w{i}")["source"].alias(f"l{i}") for i in (1, 2, 3)))
    return rounded(A.operation_f1(ops.select("conv_id", "turn", F.col("l1").alias("auto"), F.array("l2", "l3").alias("refs")), ["conv_id", "turn"]))


def sentence_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turns(spark, sf_dir, 2).select("conv_id", "turn", T.words(F.col("t0")).alias("orig"), T.words(F.col("t1")).alias("sys"))
    ratio = T.boundary_sentences(F.col("sys")) / F.greatest(T.boundary_sentences(F.col("orig")), F.lit(1))
    labels = A.annotate(p).select("conv_id", "turn", A.sentence_labels(F.col("labels"), ratio).alias("s"))
    return labels.groupBy(F.array_join("s", "").alias("labels")).agg(F.count("*").alias("n"))


def coalesce_keyfacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of facts that is not empty, for labelled documents."""
    l = table(spark, sf_dir, "labels")
    lists = [F.when(F.col(c) == 1, F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in ("quality", "toxic")]
    return l.select("doc_id", F.coalesce(F.get(N.first_facts(*lists), F.lit(0)), F.lit("none")).alias("origin"))


def drop_empty_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output records as JSON: empty fields are gone, zeros stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), (F.col("n_chars") * 0).alias("zero"))
    n = N.drop_empty(d)
    return n.select("doc_id", F.to_json(F.struct("doc_id", "lang", "zero")).alias("record"))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = X.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])
    return left.groupBy("source").agg(F.count("*").alias("n_left"), F.min("doc_id").alias("first_left"))


def prefix_split_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts as split sentences, collapsed again."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_id", "line"))
    parts = F.transform(F.split(F.replace("line", F.lit(". "), F.lit(".<::::>")), "<::::>"), T.strip)
    return lines.select("doc_id", "row_id", F.size(parts).alias("n_parts"), F.length(F.array_join(parts, " ")).alias("n_chars"))


def placeholder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "person@1 went to loc@1 ."), (2, "nobody came"), (3, "PERSON@1 PERSON@2")], "id int, text string")
    names = F.create_map(*[F.lit(x) for item in NAMES.items() for x in item])
    return rows.select("id", N.substitute(F.col("text"), names).alias("text"))


def dataset_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole evaluation, by source."""
    docs = texts(spark, sf_dir).select("doc_id", "source", "text")
    scored = E.evaluate(docs, perplexity=lambda c: F.length(c) / 10.0, figurativeness=lambda c: F.lit(0.25), emotionality=lambda c: F.lit(0.5))
    return rounded(E.statistics(E.output_records(scored), ["source"]))


def dataset_evaluation_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a whole evaluation with key facts, quiz and judge: benchmark items against their
    next ones, quizzes and replies made from the item's number."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    facts = lambda d: d.select("item_id", F.explode(F.array_distinct(T.plain_tokens(F.col("text")))).alias("entity")).select("*", F.lit("said").alias("behavior"), (1 + F.length("entity") % 3).alias("priority"))
    following = items.select((F.col("item_id") - 1).alias("item_id"), "text").join(items.select("item_id"), "item_id", "left_semi")
    i = F.col("item_id")
    answers = F.concat(F.array(F.when(i % 2 == 0, "a").otherwise("d"), F.lit("B "), F.when(i % 3 == 0, "c").otherwise("x")), F.when(i % 5 == 0, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>")))
    quiz = items.select("item_id", F.transform(F.array(*map(F.lit, "ABC")), lambda a: F.struct(a.alias("answer"))).alias("questions"), answers.alias("answers")).where("item_id % 7 <> 0")
    replies = items.select("item_id", F.explode(F.array(F.concat(F.lit("Coherence: "), (i % 5).cast("string")), F.lit("no number"), F.concat(F.lit("say "), (1 + i % 4).cast("string")))).alias("reply")).where("item_id % 4 <> 0")
    scored = E.evaluate(items, skip=frozenset({"coherence"}), figurativeness=lambda c: F.lit(0.25), emotionality=lambda c: F.lit(0.5))
    whole = E.assemble(scored, ["item_id"], N.matched_scores(facts(items), facts(following), ["item_id"]), quiz, replies)
    return rounded(E.statistics(E.output_records(whole)))


def entity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of a user."""
    r = Wd.runs(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")
    return r.groupBy("event_type").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"), F.sum("n").alias("n_events"))


def neighbour_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words around each word of a benchmark item."""
    w = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    n = w.select("item_id", F.posexplode(Wd.neighbours(F.col("w"))).alias("pos", "near"))
    return n.select("item_id", "pos", F.array_join("near", " ").alias("near"))


def request_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of requests: the latest without an error, else the latest."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("custom_id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error"))
    best = X.best_attempt(e, "custom_id")
    return best.select("custom_id", "attempt", "error", T.retryable(F.col("error")).alias("again"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (keyfact_precision_recall, keyfact_wrapped_json, keyfact_alignment, mcq_accuracy, judge_scores, score_reply_parser, sections, request_response_merge, ppl_side_statistics, binary_classification_metrics, fold_average, lcs_words, edit_operations, sentence_operations, coalesce_keyfacts, drop_empty_projection, resume_antijoin, prefix_split_file, placeholder_names, dataset_evaluation, dataset_evaluation_judged, entity_runs, neighbour_words, request_rounds)}


def _values(rows: tuple) -> str:
    def lit(x: object) -> str:
        if isinstance(x, list):
            return "CAST([" + ", ".join(map(duck.quoted, x)) + "] AS VARCHAR[])"
        return duck.quoted(x) if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_FIGURES = """g AS (SELECT l.doc_id, quality, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS guess, l.doc_id % 5 AS fold FROM labels l JOIN documents USING (doc_id)),
s AS (SELECT {by} sum(CASE WHEN quality = 1 AND guess = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN quality = 0 AND guess = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN quality = 1 AND guess = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS fn, avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END) AS accuracy FROM g WHERE quality IS NOT NULL {group}),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM s),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)"""
_SCORE_PAIR = r'"index"\s*:\s*(\d+)\s*,\s*"score"\s*:\s*(\d+)'
_SIZED = "CASE WHEN len({0}) = n THEN {0} WHEN len({0}) = n - 1 THEN list_append({0}, 0) END"
_ENTITIES = "list_distinct(regexp_extract_all(reply, '\"entity\":\"({}\\d+)\"', 1))"
_STATS = "round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL"
_VIVID = "0.4 * {0} + 0.3 * {1} + 0.3 * decorativeness"
_HEAD = r"\n(==\s*[^=\n][^=\n]*\s*==)\n"

SQL: dict[str, str] = {
    "keyfact_precision_recall": f"""WITH p AS ({turns_sql(2)}), l AS (SELECT conv_id, turn, unnest({_TOKENS.format('t1')}) AS e, 1 AS g, 0 AS t FROM p UNION ALL SELECT conv_id, turn, unnest({_TOKENS.format('t0')}), 0, 1 FROM p),
m AS (SELECT conv_id, turn, e, unnest([0, 1 + length(e) % 3]) AS priority, sum(g) AS g, sum(t) AS t FROM l GROUP BY conv_id, turn, e),
s AS (SELECT conv_id, turn, CAST(priority AS INT) AS priority, sum(g) AS ng, sum(t) AS nt, sum(least(g, t)) AS k FROM m GROUP BY ALL)
SELECT conv_id, turn, priority, round(CASE WHEN ng > 0 THEN least(1.0, k / CAST(ng AS DOUBLE)) ELSE -1.0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN least(1.0, k / CAST(nt AS DOUBLE)) ELSE -1.0 END, 6) AS recall FROM s""",
    "mcq_accuracy": f"""WITH q(id, r, a) AS ({_values(QUIZ)}) SELECT id, round(CASE WHEN len(r) > 0 AND len(r) = len(a) THEN len(list_filter(list_zip(r, a), lambda z: upper(trim(z[1])) = upper(trim(z[2])))) / CAST(len(r) AS DOUBLE) ELSE 0.0 END, 6) AS score FROM q""",
    "judge_scores": f"""WITH r(doc_id, reply) AS ({_values(REPLIES)}), s AS (SELECT doc_id, CASE WHEN regexp_extract(reply, 'Coherence:\\s*(\\d+(\\.\\d+)?)', 1) <> '' THEN CAST(regexp_extract(reply, 'Coherence:\\s*(\\d+(\\.\\d+)?)', 1) AS DOUBLE)
 WHEN regexp_extract(reply, '\\b([1-5])\\b', 1) <> '' THEN CAST(regexp_extract(reply, '\\b([1-5])\\b', 1) AS DOUBLE) END AS s FROM r) SELECT doc_id, round(coalesce(avg(s), -1.0), 6) AS score, count(s) AS n FROM s GROUP BY doc_id""",
    "sections": f"""WITH w(id, text) AS ({_values(WIKI)}), p AS (SELECT id, list_transform(regexp_extract_all(text, '{_HEAD}', 1), lambda z: {duck.strip('z')}) AS h, list_transform(string_split_regex(text, '{_HEAD}'), lambda z: {duck.strip('z')}) AS c FROM w),
u AS (SELECT id, unnest(range(0, len(c))) AS i, h, c FROM p), s AS (SELECT id, i, CASE WHEN i > 0 THEN h[i] END AS heading, c[i + 1] AS content FROM u WHERE i > 0 OR c[1] <> '')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS pos, coalesce(heading, '-') AS heading, CASE WHEN length(content) > 6 THEN substr(content, 1, 6) || ' ...[TRUNCATED]' ELSE content END AS content FROM s""",
    "request_response_merge": """SELECT 'bench:' || item_id AS custom_id, CAST(length('Rate: ' || text) AS INT) AS prompt_length,
CASE WHEN item_id % 3 <> 0 AND item_id % 5 <> 0 THEN 'reply ' || item_id || ' ' || (CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END) END AS reply,
CASE WHEN item_id % 3 = 0 THEN 'missing' WHEN item_id % 5 = 0 THEN 'status 500' END AS problem FROM benchmark""",
    "ppl_side_statistics": """WITH v AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0 AND value < 10000)
SELECT event_type, round(avg(v), 6) AS mean, round(max(CASE WHEN i = n // 2 THEN v END), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM v GROUP BY event_type""",
    "binary_classification_metrics": f"WITH {_FIGURES.format(by='', group='')} SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "fold_average": f"""WITH {_FIGURES.format(by='fold,', group='GROUP BY fold')}, l AS (SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, precision, recall, f1]) AS value FROM f)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l GROUP BY metric""",
    "coalesce_keyfacts": "SELECT doc_id, CASE WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS origin FROM labels",
    "drop_empty_projection": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR lang IS NULL THEN '{"doc_id":' || doc_id || ',"zero":0}' ELSE '{"doc_id":' || doc_id || ',"lang":"' || lang || '","zero":0}' END AS record FROM documents""",
    "resume_antijoin": "SELECT source, count(*) AS n_left, min(doc_id) AS first_left FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source",
    "prefix_split_file": f"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS row_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, CAST(row_id AS INT) AS row_id, list_transform(string_split(replace(line, '. ', '.<::::>'), '<::::>'), lambda z: {duck.strip('z')}) AS ps FROM l)
SELECT doc_id, row_id, CAST(len(ps) AS INT) AS n_parts, CAST(length(array_to_string(ps, ' ')) AS INT) AS n_chars FROM p""",
    "entity_runs": """WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l), r AS (SELECT user_id, event_type, run, count(*) AS n FROM n GROUP BY ALL)
SELECT event_type, count(*) AS n_runs, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n_events FROM r GROUP BY event_type""",
    "neighbour_words": f"""WITH w AS (SELECT item_id, {duck.words('text')} AS w FROM benchmark), u AS (SELECT item_id, w, unnest(range(0, len(w))) AS pos FROM w)
SELECT item_id, CAST(pos AS INT) AS pos, array_to_string(list_concat(w[greatest(pos - 2, 1):pos], w[pos + 2:pos + 4]), ' ') AS near FROM u""",
    "request_rounds": """SELECT custom_id, attempt, error, error IS NOT NULL AS again FROM (SELECT CAST(user_id AS VARCHAR) AS custom_id, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', event_id DESC) AS r FROM events) x WHERE r = 1""",
    "keyfact_wrapped_json": f"""WITH r(id, reply) AS ({_values(FACT_REPLIES)}), l AS (SELECT id, CASE WHEN json_type(reply) = 'ARRAY' THEN reply
  ELSE json_extract(reply, '$.' || coalesce(CASE WHEN json_type(reply, '$.keyfacts') IS NOT NULL THEN 'keyfacts' WHEN json_type(reply, '$.key_facts') IS NOT NULL THEN 'key_facts' END, list_filter(json_keys(reply), lambda k: json_type(reply, '$.' || k) = 'ARRAY')[1])) END AS facts FROM r),
f AS (SELECT id, coalesce(json_extract_string(facts, '$[*].entity'), []) AS e, json_extract_string(facts, '$[*].priority') AS p FROM l)
SELECT id, CAST(len(e) AS INT) AS n_facts, array_to_string(list_transform(range(1, len(e) + 1), lambda i: e[i] || ':' || p[i]), ',') AS facts FROM f""",
    "keyfact_alignment": f"""WITH r(id, asked, reply) AS ({_values(PAIR_REPLIES)}), d AS (SELECT id, asked, len({_ENTITIES.format('g')}) AS g, len({_ENTITIES.format('t')}) AS t, unnest([0, 1, 2, 3]) AS priority FROM r)
SELECT id, priority, CASE WHEN priority > 1 THEN -1.0 WHEN priority = asked THEN round(g / 3.0::DOUBLE, 6) ELSE 0.0 END AS precision, CASE WHEN priority > 1 THEN -1.0 WHEN priority = asked THEN round(t / 3.0::DOUBLE, 6) ELSE 0.0 END AS recall FROM d""",
    "score_reply_parser": f"""WITH r(id, n, reply) AS ({_values(SCORE_REPLIES)}), t AS (SELECT id, n, regexp_replace(trim(reply), '^```[A-Za-z0-9_-]*\\s*|\\s*```$', '', 'g') AS x FROM r),
a AS (SELECT id, n, CASE WHEN json_valid(x) THEN CAST(json_extract_string(x, '$.scores[*]') AS INT[]) END AS plain, CAST(regexp_extract_all(regexp_extract(x, '"scores"\\s*:\\s*\\[([^\\]]+)\\]', 1), '-?\\d+') AS INT[]) AS loose,
  list_filter(list_zip(CAST(regexp_extract_all(x, '{_SCORE_PAIR}', 1) AS INT[]), CAST(regexp_extract_all(x, '{_SCORE_PAIR}', 2) AS INT[])), lambda z: z[2] <= 10 AND z[1] < n) AS pairs FROM t),
b AS (SELECT id, n, {_SIZED.format('plain')} AS plain, {_SIZED.format('loose')} AS loose, list_transform(range(0, n), lambda k: list_filter(pairs, lambda z: z[1] = k)[-1][2]) AS pairs FROM a)
SELECT id, array_to_string(CASE WHEN len(list_filter(plain, lambda z: z BETWEEN 0 AND 10)) = n THEN plain WHEN len(list_filter(loose, lambda z: z BETWEEN 0 AND 10)) = n THEN loose WHEN len(list_filter(pairs, lambda z: z IS NOT NULL)) = n THEN pairs END, ',') AS scores FROM b""",
    "lcs_words": f"""WITH RECURSIVE p AS ({turns_sql(2)}), w AS (SELECT conv_id, turn, {duck.words('t0')} AS a, {duck.words('t1')} AS b FROM p),
s AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(b, lambda z: 0) AS best FROM w UNION ALL
  SELECT conv_id, turn, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: CASE WHEN b[q] = a[i + 1] THEN 1 + CASE WHEN q > 1 THEN best[q - 1] ELSE 0 END ELSE best[q] END))) FROM s WHERE i < len(a))
SELECT conv_id, turn, CAST(coalesce(best[-1], 0) AS INT) AS n_common FROM s WHERE i = len(a)""",
    "dataset_evaluation": f"""WITH {_counts('doc_id, source, text', 'documents')}, f AS (SELECT *, {_DOC_FKGL} AS fkgl FROM r), {_DECOR},
l AS (SELECT source, 'simplicity_fkgl_score' AS metric, fkgl AS value FROM f WHERE fkgl >= 0 UNION ALL SELECT source, 'coherence_ppl_score', length(text) / 10.0::DOUBLE FROM f WHERE trim(coalesce(text, '')) <> ''
  UNION ALL SELECT source, unnest(['vividness_score', 'figurativeness', 'emotionality', 'decorativeness']), unnest([{_VIVID.format('g', 'e')}, g, e, decorativeness]) FROM (SELECT *, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 ELSE 0.25 END::DOUBLE AS g, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 ELSE 0.5 END::DOUBLE AS e FROM dec) x)
SELECT source, metric, {_STATS}""",
    "dataset_evaluation_judged": f"""WITH {_counts('item_id', 'benchmark')}, f AS (SELECT *, {_DOC_FKGL} AS fkgl FROM r), {_DECOR.replace('FROM documents', 'FROM benchmark')},
k AS (SELECT a.item_id, unnest({_TOKENS.format('a.text')}) AS e, 1 AS g, 0 AS t FROM benchmark a UNION ALL SELECT a.item_id, unnest({_TOKENS.format('b.text')}), 0, 1 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
m AS (SELECT item_id, e, unnest([0, 1 + length(e) % 3]) AS priority, sum(g) AS g, sum(t) AS t FROM k GROUP BY item_id, e),
s AS (SELECT item_id, priority, sum(g) AS ng, sum(t) AS nt, sum(least(g, t)) AS k FROM m GROUP BY ALL),
l AS (SELECT 'simplicity_fkgl_score' AS metric, fkgl AS value FROM f WHERE fkgl >= 0 UNION ALL SELECT unnest(['vividness_score', 'figurativeness', 'emotionality', 'decorativeness']), unnest([{_VIVID.format('0.25', '0.5')}, 0.25, 0.5, decorativeness]) FROM dec
  UNION ALL SELECT 'keyfacts_precision' || CASE WHEN priority > 0 THEN '_by_priority.priority_' || priority ELSE '' END, least(1.0, k / CAST(ng AS DOUBLE)) FROM s WHERE ng > 0
  UNION ALL SELECT 'keyfacts_recall' || CASE WHEN priority > 0 THEN '_by_priority.priority_' || priority ELSE '' END, least(1.0, k / CAST(nt AS DOUBLE)) FROM s WHERE nt > 0
  UNION ALL SELECT 'informativeness_score', CASE WHEN item_id % 5 = 0 THEN 0 ELSE (1 + CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END) / 3.0::DOUBLE END FROM benchmark WHERE item_id % 7 <> 0
  UNION ALL SELECT 'coherence_llm_score', (item_id % 5 + 1 + item_id % 4) / 2.0::DOUBLE FROM benchmark WHERE item_id % 4 <> 0)
SELECT metric, {_STATS}""",
    "placeholder_names": "SELECT * FROM (VALUES (1, 'ann lee went to rome .'), (2, 'nobody came'), (3, 'ann lee PERSON@2')) t(id, text)",
}
