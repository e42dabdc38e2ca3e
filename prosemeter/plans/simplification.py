"""Simplification metrics over conversations: a turn is the source, the next the output, the
two after that the references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemeter.functions import text as T
from prosemeter.operators import report as R
from prosemeter.operators import simplification as M
from prosemeter.operators import stats as S
from prosemeter.plans import duck
from prosemeter.plans.common import Query, rounded, samples, texts, turn_runs, turns, turns_sql

KEYS = ["conv_id", "turn"]


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = texts(spark, sf_dir, "conversations").select("role", T.words(F.col("text")).alias("w"))
    g = c.select("role", F.inline(M.gram_rows(F.col("w")))).groupBy("role", "n", "gram").count()
    return g.groupBy("role", "n").agg(F.count("*").alias("n_distinct"), F.sum("count").alias("n_grams"), F.max("count").alias("most"))


def sari_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sari(M.tokenised(samples(spark, sf_dir)), KEYS, []).select("sari"))


def sari_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.sari_stats(M.gram_counts(M.tokenised(samples(spark, sf_dir)), KEYS), [])
    return rounded(M.sari_scores(s, [], f1_deletion=False).select("add", "keep", F.col("del").alias("del_precision"), "sari"))


def sari_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sari(M.tokenised(samples(spark, sf_dir)), KEYS, [], micro=True))


def sari_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sari(M.tokenised(samples(spark, sf_dir), legacy=True), KEYS, []))


def sari_by_row_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounded(M.sari(M.tokenised(samples(spark, sf_dir)), KEYS, KEYS))
    return S.top_k(rows, F.desc("sari"), KEYS)


def _two_systems(s: DataFrame) -> DataFrame:
    """Each sample under two systems: the next turn, and the source itself."""
    both = F.array(F.struct(F.lit("next").alias("system"), F.col("sys").alias("sys")), F.struct(F.lit("copy").alias("system"), F.col("orig").alias("sys")))
    return s.select(*KEYS, "orig", "refs", F.inline(both))


def sari_relative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*KEYS, "system"]
    rows = M.sari(_two_systems(M.lowered(samples(spark, sf_dir, turn_runs))), keys, keys).select(*keys, "sari")
    return rounded(M.relative_sari(rows, KEYS))


def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bleu(M.tokenised(samples(spark, sf_dir), lowercase=False), KEYS, []))


def bleu_sentence_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.bleu(M.tokenised(samples(spark, sf_dir), lowercase=False), KEYS, KEYS, smooth="floor", effective=True)
    return rounded(rows.agg(F.avg("bleu").alias("bleu"), F.count("*").alias("n")))


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.token_f1_rows(M.tokenised(samples(spark, sf_dir)), KEYS).agg((100 * F.avg("f1")).alias("f1_token"), F.count("*").alias("n")))


def baselines_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leaderboard(M.baselines(samples(spark, sf_dir, turn_runs), M.SYSTEMS[:3], low=True), KEYS, low=True)


def reference_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leaderboard(M.baselines(samples(spark, sf_dir, turn_runs), M.SYSTEMS[3:], low=True), KEYS, low=True)


def quality_estimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turns(spark, sf_dir, 2).select("conv_id", "turn", F.col("t0").alias("orig"), F.col("t1").alias("sys"))
    q = M.quality_features(pairs)
    return rounded(q.agg(*(F.avg(c).alias(c) for c in ("compression", "splits", "edit_similarity", "exact", "additions", "deletions"))))


def scores_by_length_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    limits = S.length_limits(s, F.length("orig"))
    # five rows of limits: the join is a broadcast lookup
    binned = s.join(F.broadcast(limits), (F.length("orig") >= F.col("low")) & (F.length("orig") < F.col("high")))
    by = ["bin", "low", "high"]
    scores = M.sari(M.tokenised(binned), [*KEYS, *by], by)
    sizes = binned.groupBy(*by).agg(F.count("*").alias("n"))
    return rounded(scores.join(sizes, by))


def alignment_shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.description(samples(spark, sf_dir)))


def feature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("orig", F.inline(F.array(F.struct(F.lit("system").alias("kind"), F.col("sys").alias("out")), F.struct(F.lit("reference").alias("kind"), F.col("refs")[0].alias("out")))))
    return S.histogram(s, F.length("out") / F.length("orig"), 0, 5, 100, ["kind"])


# ---------------------------------------------------------------- SQL


def _samples(lower: bool = True, legacy: bool = False, systems: str | None = None) -> str:
    """CTE smp(conv_id, turn, system, o, s, r0, r1): token lists."""
    low = lower and not legacy
    w = lambda x: duck.words(x, low)
    o = duck.split_words(duck.squeeze("orig")) if legacy else w("orig")
    rows = systems or "SELECT conv_id, turn, 'system' AS system, t0 AS orig, t1 AS sys, t2 AS r0, t3 AS r1 FROM raw"
    return f"raw AS ({turns_sql(4)}), txt AS ({rows}), smp AS (SELECT conv_id, turn, system, orig AS otext, sys AS stext, {o} AS o, {w('sys')} AS s, {w('r0')} AS r0, {w('r1')} AS r1 FROM txt)"


_GRAMS = """long AS (SELECT conv_id, turn, system, unnest([-1, 0, 1, 2]) AS side, unnest([o, s, r0, r1]) AS tk FROM smp),
ord AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM long),
gr AS (SELECT conv_id, turn, system, side, n, unnest(list_transform(range(1, len(tk) - n + 2), lambda i: array_to_string(tk[i:i + n - 1], ' '))) AS gram FROM ord),
one AS (SELECT conv_id, turn, system, n, gram, side, count(*) AS c FROM gr GROUP BY ALL),
cnt AS (SELECT conv_id, turn, system, n, gram, coalesce(sum(c) FILTER (side = -1), 0) AS o, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side > 0), 0) AS r, coalesce(max(c) FILTER (side > 0), 0) AS rm FROM one GROUP BY ALL)"""


def _sari(by: str, micro: bool = False, f1_deletion: bool = True, counts: str = "cnt") -> str:
    """CTE sari(by, add, keep, del)."""
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}, n" if by else "GROUP BY n"
    ratio = lambda a, c: f"CASE WHEN {c} > 0 THEN CAST({a} AS DOUBLE) / {c} ELSE 0.0 END"
    f1 = lambda p, r: f"CASE WHEN {p} > 0 AND {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
    ops = []
    for op in ("add", "keep", "del"):
        only_p = op == "del" and not f1_deletion
        if micro:
            p, r = f"(sum({op}_p) / 4)", f"(sum({op}_r) / 4)"
            ops.append(f"100 * ({p if only_p else f1(p, r)}) AS {op}")
        else:
            ops.append(f"100 * sum({f'{op}_p' if only_p else f1(f'{op}_p', f'{op}_r')}) / 4 AS {op}")
    pr = ", ".join(f"{ratio(f'{op}_c', f'{op}_s')} AS {op}_p, {ratio(f'{op}_c', f'{op}_r')} AS {op}_r" for op in ("add", "keep", "del"))
    return f"""st AS (SELECT {b}n, sum(CASE WHEN o = 0 AND s > 0 AND r > 0 THEN 1 ELSE 0 END) AS add_c, sum(CASE WHEN o = 0 AND s > 0 THEN 1 ELSE 0 END) AS add_s, sum(CASE WHEN o = 0 AND r > 0 THEN 1 ELSE 0 END) AS add_r,
  sum(least(o * 2, s * 2, r)) AS keep_c, sum(least(o * 2, s * 2)) AS keep_s, sum(least(o * 2, r)) AS keep_r,
  sum(least(greatest(o * 2 - s * 2, 0), greatest(o * 2 - r, 0))) AS del_c, sum(greatest(o * 2 - s * 2, 0)) AS del_s, sum(greatest(o * 2 - r, 0)) AS del_r FROM {counts} {g}),
pr AS (SELECT {b}n, {pr} FROM st), sari AS (SELECT {b}{', '.join(ops)} FROM pr {'GROUP BY ' + by if by else ''})"""


def _bleu(by: str, smooth: str = "exp", effective: bool = False) -> str:
    """CTE bleu(by, bleu)."""
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    cols = ", ".join(f"coalesce(sum(least(s, rm)) FILTER (n = {n}), 0) AS c{n}, coalesce(sum(s) FILTER (n = {n}), 0) AS t{n}" for n in range(1, 5))
    logs = []
    for n in range(1, 5):
        zeros = " + ".join(f"(CASE WHEN c{j} = 0 THEN 1 ELSE 0 END)" for j in range(1, n + 1))
        small = f"100.0 / (pow(2, {zeros}) * t{n})" if smooth == "exp" else f"10.0 / t{n}"
        alive = " AND ".join(f"t{j} > 0" for j in range(1, n + 1))
        logs.append(f"(CASE WHEN {alive} THEN ln(CASE WHEN c{n} = 0 THEN {small} ELSE 100.0 * c{n} / t{n} END) ELSE {'0.0' if effective else '-9999999999.0'} END)")
    used = "greatest(1, " + " + ".join(f"(CASE WHEN t{n} > 0 THEN 1 ELSE 0 END)" for n in range(1, 5)) + ")" if effective else "4"
    join = f"USING ({by})" if by else "ON true"
    return f"""hit AS (SELECT {b}{cols} FROM cnt {g}),
ln AS (SELECT {b}sum(len(s)) AS sl, sum(CASE WHEN abs(len(r0) - len(s)) < abs(len(r1) - len(s)) THEN len(r0) WHEN abs(len(r0) - len(s)) > abs(len(r1) - len(s)) THEN len(r1) ELSE least(len(r0), len(r1)) END) AS rl FROM smp {g}),
bleu AS (SELECT {b}CASE WHEN sl > 0 AND c1 + c2 + c3 + c4 > 0 THEN (CASE WHEN sl >= rl THEN 1.0 ELSE exp(1 - CAST(rl AS DOUBLE) / sl) END) * exp(({' + '.join(logs)}) / {used}) ELSE 0.0 END AS bleu FROM ln LEFT JOIN hit {join})"""


_F1 = """f1l AS (SELECT conv_id, turn, system, s, unnest([1, 2]) AS ref_id, unnest([r0, r1]) AS r FROM smp),
f1t AS (SELECT conv_id, turn, system, ref_id, unnest(list_concat(list_transform(s, lambda z: {'t': z, 'a': 1, 'b': 0}), list_transform(r, lambda z: {'t': z, 'a': 0, 'b': 1}))) AS x FROM f1l),
f1m AS (SELECT conv_id, turn, system, ref_id, x.t AS t, least(sum(x.a), sum(x.b)) AS m FROM f1t GROUP BY ALL),
f1c AS (SELECT conv_id, turn, system, ref_id, sum(m) AS c FROM f1m GROUP BY ALL),
f1p AS (SELECT l.conv_id, l.turn, l.system, coalesce(CASE WHEN len(s) > 0 THEN CAST(c AS DOUBLE) / len(s) ELSE 0 END, 0) AS p, coalesce(CASE WHEN len(r) > 0 THEN CAST(c AS DOUBLE) / len(r) ELSE 0 END, 0) AS q FROM f1l l LEFT JOIN f1c USING (conv_id, turn, system, ref_id)),
f1r AS (SELECT conv_id, turn, system, max(CASE WHEN p > 0 AND q > 0 THEN 2 * p * q / (p + q) ELSE 0 END) AS f1 FROM f1p GROUP BY ALL)"""

_R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_TRUNC = f"array_to_string(({duck.split_words(duck.squeeze('t0'))})[1:CAST(floor(len({duck.split_words(duck.squeeze('t0'))}) * 0.8) AS INT)], ' ') || '.'"
_SYSTEMS = f"""SELECT conv_id, turn, 'system' AS system, t0 AS orig, t1 AS sys, t2 AS r0, t3 AS r1 FROM raw UNION ALL SELECT conv_id, turn, 'Identity baseline', t0, t0, t2, t3 FROM raw UNION ALL SELECT conv_id, turn, 'Truncate baseline', t0, {_TRUNC}, t2, t3 FROM raw"""
_REFROW = "SELECT conv_id, turn, 'Reference*' AS system, t0 AS orig, t2 AS sys, t3 AS r0, t3 AS r1 FROM raw"
_TWO = "SELECT conv_id, turn, 'next' AS system, t0 AS orig, t1 AS sys, t2 AS r0, t3 AS r1 FROM raw UNION ALL SELECT conv_id, turn, 'copy', t0, t0, t2, t3 FROM raw"


def _board(systems: str) -> str:
    fk = f"""fw AS (SELECT system, {duck.words('stext')} AS w FROM smp), fs AS (SELECT system, sum(len(w)) AS nw, sum({duck.boundary_sentences('w')}) AS ns, sum(coalesce(list_sum(list_transform(w, lambda q: {duck.syllables('q')})), 0)) AS ny FROM fw GROUP BY system),
fk AS (SELECT system, CASE WHEN nw = 0 OR ns = 0 THEN 0.0 ELSE greatest(0.0, 0.39 * (CAST(nw AS DOUBLE) / ns) + 11.8 * (CAST(ny AS DOUBLE) / nw) - 15.59) END AS fkgl FROM fs)"""
    return f"WITH {_samples(systems=systems)}, {_GRAMS}, {_sari('system')}, {_bleu('system')}, {_F1}, {fk}, ft AS (SELECT system, 100 * avg(f1) AS f FROM f1r GROUP BY system) SELECT system, round(bleu, 2) AS bleu, round((add + keep + del) / 3, 2) AS sari, round(fkgl, 2) AS fkgl, round(f, 2) AS f1_token FROM bleu JOIN sari USING (system) JOIN fk USING (system) JOIN ft USING (system)"


def _prop(a: str, b: str) -> str:
    left = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: greatest(len(list_filter({a}, lambda q: q = w)) - len(list_filter({b}, lambda q: q = w)), 0))), 0)"
    return f"CASE WHEN greatest(len({a}), len({b})) > 0 THEN {left} / CAST(greatest(len({a}), len({b})) AS DOUBLE) ELSE 0.0 END"


def _fold(x: str) -> str:
    """One byte a character, distinct for the letters of the tables: DuckDB's levenshtein counts bytes."""
    return f"translate({x}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '{_CONTROL}')"


_CONTROL = "".join(map(chr, [*range(1, 9), *range(14, 32)]))

SQL: dict[str, str] = {
    "ngram_counts": f"""WITH w AS (SELECT role, {duck.words('text')} AS tk FROM conversations), o AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM w),
g AS (SELECT role, n, unnest(list_transform(range(1, len(tk) - n + 2), lambda i: array_to_string(tk[i:i + n - 1], ' '))) AS gram FROM o), c AS (SELECT role, n, gram, count(*) AS c FROM g GROUP BY ALL)
SELECT role, n, count(*) AS n_distinct, CAST(sum(c) AS BIGINT) AS n_grams, max(c) AS most FROM c GROUP BY ALL""",
    "sari_corpus": f"WITH {_samples()}, {_GRAMS}, {_sari('')} SELECT round((add + keep + del) / 3, 6) AS sari FROM sari",
    "sari_by_operation": f"WITH {_samples()}, {_GRAMS}, {_sari('', f1_deletion=False)} SELECT {_R('add', 'keep')}, round(del, 6) AS del_precision, round((add + keep + del) / 3, 6) AS sari FROM sari",
    "sari_micro": f"WITH {_samples()}, {_GRAMS}, {_sari('', micro=True)} SELECT {_R('add', 'keep', 'del')}, round((add + keep + del) / 3, 6) AS sari FROM sari",
    "sari_legacy": f"WITH {_samples(legacy=True)}, {_GRAMS}, {_sari('')} SELECT {_R('add', 'keep', 'del')}, round((add + keep + del) / 3, 6) AS sari FROM sari",
    "sari_by_row_topk": f"WITH {_samples()}, {_GRAMS}, {_sari('conv_id, turn')} SELECT conv_id, turn, round((add + keep + del) / 3, 6) AS sari, {_R('add', 'keep', 'del')} FROM sari ORDER BY round((add + keep + del) / 3, 6) DESC, conv_id, turn LIMIT 50",
    "sari_relative_window": f"WITH {_samples(systems=_TWO)}, {_GRAMS}, {_sari('conv_id, turn, system')}, z AS (SELECT conv_id, turn, system, (add + keep + del) / 3 AS v FROM sari) SELECT conv_id, turn, system, round(v, 6) AS sari, round(CASE WHEN avg(v) OVER (PARTITION BY conv_id, turn) > 0 THEN v / avg(v) OVER (PARTITION BY conv_id, turn) ELSE 0.0 END, 6) AS relative FROM z",
    "bleu_corpus": f"WITH {_samples(lower=False)}, {_GRAMS}, {_bleu('')} SELECT {_R('bleu')} FROM bleu",
    "bleu_sentence_mean": f"WITH {_samples(lower=False)}, {_GRAMS}, {_bleu('conv_id, turn', 'floor', True)} SELECT round(avg(bleu), 6) AS bleu, count(*) AS n FROM bleu",
    "token_f1": f"WITH {_samples()}, {_F1} SELECT round(100 * avg(f1), 6) AS f1_token, count(*) AS n FROM f1r",
    "baselines_leaderboard": _board(_SYSTEMS),
    "reference_row": _board(_REFROW),
    "quality_estimation": f"""WITH p AS (SELECT t0 AS a, t1 AS b FROM ({turns_sql(2)}) x), n AS (SELECT {duck.normalize('a', False)} AS o, {duck.normalize('b', False)} AS s FROM p),
w AS (SELECT *, {duck.split_words('o')} AS ow, {duck.split_words('s')} AS sw FROM n),
f AS (SELECT CASE WHEN length(o) > 0 THEN length(s) / CAST(length(o) AS DOUBLE) ELSE 0 END AS compression, ({duck.boundary_sentences('sw')}) / CAST(greatest({duck.boundary_sentences('ow')}, 1) AS DOUBLE) AS splits,
  CASE WHEN o = s THEN 1.0 ELSE 0.0 END AS exact, {_prop('sw', 'ow')} AS additions, {_prop('ow', 'sw')} AS deletions, o, s FROM w)
SELECT round(avg(compression), 6) AS compression, round(avg(splits), 6) AS splits, round(avg(CASE WHEN greatest(length(o), length(s)) > 0 THEN 1 - levenshtein({_fold('o')}, {_fold('s')}) / CAST(greatest(length(o), length(s)) AS DOUBLE) ELSE 1 END), 6) AS edit_similarity, round(avg(exact), 6) AS exact, round(avg(additions), 6) AS additions, round(avg(deletions), 6) AS deletions FROM f""",
    "scores_by_length_bin": f"""WITH raw0 AS ({turns_sql(4)}), l AS (SELECT length(t0) AS n, row_number() OVER (ORDER BY length(t0)) - 1 AS i, count(*) OVER () AS c, max(length(t0)) OVER () AS top FROM raw0),
e AS (SELECT CAST(i // (c // 5) AS INT) AS bin, n AS low, top FROM l WHERE i % (c // 5) = 0 AND i // (c // 5) < 5), lim AS (SELECT bin, low, coalesce(lead(low) OVER (ORDER BY bin), top + 1) AS high FROM e),
{_samples()}, {_GRAMS}, key AS (SELECT conv_id, turn, bin, low, high FROM smp JOIN lim ON length(otext) >= low AND length(otext) < high),
cb AS (SELECT cnt.*, bin, low, high FROM cnt JOIN key USING (conv_id, turn)), {_sari('bin, low, high', counts='cb')}, sz AS (SELECT bin, count(*) AS n FROM key GROUP BY bin)
SELECT bin, low, high, round((add + keep + del) / 3, 6) AS sari, {_R('add', 'keep', 'del')}, n FROM sari JOIN sz USING (bin)""",
    "alignment_shape_stats": f"""WITH {_samples(lower=False)}, p AS (SELECT o, unnest([0, 1]) AS ref_id, unnest([r0, r1]) AS r FROM smp),
n AS (SELECT ref_id, len(o) AS ow, len(r) AS rw, greatest({duck.boundary_sentences('o')}, 1) > 1 AS a, greatest({duck.boundary_sentences('r')}, 1) > 1 AS b FROM p)
SELECT CAST(sum(CASE WHEN ref_id = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_samples, count(DISTINCT ref_id) AS n_refs, round(avg(ow), 6) AS words_source, round(avg(rw), 6) AS words_reference,
round(100 * avg(CASE WHEN NOT a AND NOT b THEN 1.0 ELSE 0.0 END), 1) AS one_to_one, round(100 * avg(CASE WHEN NOT a AND b THEN 1.0 ELSE 0.0 END), 1) AS one_to_n, round(100 * avg(CASE WHEN a AND b THEN 1.0 ELSE 0.0 END), 1) AS n_to_n, round(100 * avg(CASE WHEN a AND NOT b THEN 1.0 ELSE 0.0 END), 1) AS n_to_one FROM n""",
    "feature_histogram": f"""WITH r AS ({turns_sql(4)}), l AS (SELECT 'system' AS kind, length(t1) / CAST(length(t0) AS DOUBLE) AS x FROM r UNION ALL SELECT 'reference', length(t2) / CAST(length(t0) AS DOUBLE) FROM r)
SELECT kind, CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 5 THEN 101 ELSE floor(100.0 * x / 5.0) + 1 END AS INT) AS bin, count(*) AS n FROM l GROUP BY ALL""",
}
QUERIES: dict[str, Query] = {f.__name__: f for f in (ngram_counts, sari_corpus, sari_by_operation, sari_micro, sari_legacy, sari_by_row_topk, sari_relative_window, bleu_corpus, bleu_sentence_mean, token_f1, baselines_leaderboard, reference_row, quality_estimation, scores_by_length_bin, alignment_shape_stats, feature_histogram)}
