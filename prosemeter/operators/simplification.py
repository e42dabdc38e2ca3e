"""Simplification metrics over samples.

A sample is a row of key columns, `orig` and `sys` (token arrays) and `refs` (an array of
token arrays). SARI and the leaderboard count a sample's grams within its row
(`functions/grams.py`) and shuffle sums only. Elsewhere grams are rows that stay in their
sample's partition: the groupings contain the key columns. Every count is an integer, so no
result depends on the partitioning.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemeter.functions import text as T
from prosemeter.functions.grams import ORDER, SUMS, sample_sums
from prosemeter.functions.words import levenshtein, shared_tokens


def tokenised(rows: DataFrame, lowercase: bool = True, tokenizer: str = "13a", legacy: bool = False) -> DataFrame:
    """orig, sys (strings) and refs (array of strings) as token arrays.

    legacy: nothing is lower-cased, and the source is split on white space only.
    """
    low = lowercase and not legacy
    of = lambda c: T.words(c, low, tokenizer)
    source = T.split_words(T.squeeze(F.col("orig"))) if legacy else of(F.col("orig"))
    return rows.withColumns({"orig": source, "sys": of(F.col("sys")), "refs": F.transform("refs", of)})


def lowered(rows: DataFrame) -> DataFrame:
    """orig, sys and refs in lower case, still texts: `sari` and `leaderboard` cut them into the tokens that
    `tokenised` gives by default, at a fraction of its time."""
    return rows.withColumns({"orig": F.lower("orig"), "sys": F.lower("sys"), "refs": F.transform("refs", F.lower)})


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, with repeats."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_rows(tokens: Column, order: int = ORDER) -> Column:
    """Structs (n, gram) of all orders."""
    return F.concat(*(_tagged(tokens, n) for n in range(1, order + 1)))


def _tagged(tokens: Column, n: int) -> Column:
    return F.transform(ngrams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def sides(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, side, n, gram): side -1 the source, 0 the output, 1.. the references."""
    long = samples.select(
        *keys, F.size("refs").alias("k"),
        F.posexplode(F.concat(F.array("orig", "sys"), F.col("refs"))).alias("side", "tokens"),
    )
    return long.select(*keys, "k", (F.col("side") - 1).alias("side"), F.inline(gram_rows(F.col("tokens"))))


def gram_counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, n, gram, o, s, r, r_max): counts in source and output, sum and maximum over references."""
    one = sides(samples, keys).groupBy(*keys, "k", "n", "gram", "side").agg(F.count("*").alias("c"))
    pick = lambda test, of: F.coalesce(of(F.when(test, F.col("c"))), F.lit(0)).cast("long")
    return one.groupBy(*keys, "k", "n", "gram").agg(
        pick(F.col("side") == -1, F.sum).alias("o"), pick(F.col("side") == 0, F.sum).alias("s"),
        pick(F.col("side") > 0, F.sum).alias("r"), pick(F.col("side") > 0, F.max).alias("r_max"),
    )


def sari_stats(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, nine sums)."""
    o, s, r, k = (F.col(c) for c in ("o", "s", "r", "k"))
    keep_sys, keep_ref = F.least(o * k, s * k), F.least(o * k, r)
    del_sys, del_ref = F.greatest(o * k - s * k, F.lit(0)), F.greatest(o * k - r, F.lit(0))
    parts = {
        "add_correct": F.when((o == 0) & (s > 0) & (r > 0), 1).otherwise(0), "add_sys": F.when((o == 0) & (s > 0), 1).otherwise(0), "add_ref": F.when((o == 0) & (r > 0), 1).otherwise(0),
        "keep_correct": F.least(keep_sys, keep_ref), "keep_sys": keep_sys, "keep_ref": keep_ref,
        "del_correct": F.least(del_sys, del_ref), "del_sys": del_sys, "del_ref": del_ref,
    }
    return counts.groupBy(*by, "n").agg(*(F.sum(parts[c]).cast("long").alias(c) for c in SUMS))


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0)


def sari_scores(stats: DataFrame, by: list[str], micro: bool = False, f1_deletion: bool = True) -> DataFrame:
    """(by, sari, add, keep, del) in percent."""
    out = {}
    for op in ("add", "keep", "del"):
        p, r = ratio(f"{op}_correct", f"{op}_sys"), ratio(f"{op}_correct", f"{op}_ref")
        if micro:
            score = f1(F.sum(p) / ORDER, F.sum(r) / ORDER) if op != "del" or f1_deletion else F.sum(p) / ORDER
        else:
            score = F.sum(f1(p, r) if op != "del" or f1_deletion else p) / ORDER
        out[op] = (100 * score).alias(op)
    scores = stats.groupBy(*by).agg(*out.values())
    return scores.select(*by, ((F.col("add") + F.col("keep") + F.col("del")) / 3).alias("sari"), "add", "keep", "del")


def row_sums(samples: DataFrame, by: list[str], whole: bool = False) -> DataFrame:
    """(by, the sums of `grams.sample_sums`) of each sample, tokenised or lowered."""
    texts = dict(samples.dtypes)["orig"] == "string"
    joined = lambda c: F.array_join(c, " ")
    columns = [F.col(c) for c in ("orig", "sys", "refs")] if texts else [joined(F.col("orig")), joined(F.col("sys")), F.transform("refs", joined)]
    sums = sample_sums(texts, whole).asNondeterministic()  # else a filter on a sum makes a second call
    return samples.select(*by, sums(*columns).alias("__s")).select(*by, "__s.*")


def sari_of(micro: bool = False, f1_deletion: bool = True) -> list[Column]:
    """sari, add, keep, del of a row of the nine sums of all orders."""
    out = {}
    for op in ("add", "keep", "del"):
        p, r = ([ratio(f"{op}_correct{n}", f"{op}_{of}{n}") for n in range(1, ORDER + 1)] for of in ("sys", "ref"))
        total = lambda x: reduce(add, x)
        if micro:
            score = f1(total(p) / ORDER, total(r) / ORDER) if op != "del" or f1_deletion else total(p) / ORDER
        else:
            score = total(map(f1, p, r) if op != "del" or f1_deletion else p) / ORDER
        out[op] = 100 * score
    return [((out["add"] + out["keep"] + out["del"]) / 3).alias("sari"), *(c.alias(op) for op, c in out.items())]


def sari(samples: DataFrame, keys: list[str], by: list[str], **options) -> DataFrame:
    """(by, sari, add, keep, del) in percent of samples, tokenised or lowered; samples without tokens do not count."""
    sums = row_sums(samples, by).where("grams > 0")
    if set(by) != set(keys):
        sums = sums.groupBy(*by).agg(*(F.sum(f"{c}{n}").alias(f"{c}{n}") for c in SUMS for n in range(1, ORDER + 1)))
    return sums.select(*by, *sari_of(**options))


def lengths(samples: DataFrame) -> DataFrame:
    """Adds sys_len and ref_len, the length of the reference closest to it (the shorter on ties)."""
    n = F.size("sys")
    closest = F.array_min(F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - n).alias("d"), F.size(r).alias("l"))))
    return samples.withColumns({"sys_len": n.cast("long"), "ref_len": closest["l"].cast("long")})


def bleu_stats(samples: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, c1..c4, t1..t4, sys_len, ref_len): clipped matches and totals of each order."""
    at = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0)).cast("long")
    hits = counts.groupBy(*by).agg(*(at(F.least("s", "r_max"), n).alias(f"c{n}") for n in range(1, ORDER + 1)), *(at(F.col("s"), n).alias(f"t{n}") for n in range(1, ORDER + 1)))
    sizes = lengths(samples).groupBy(*by).agg(F.sum("sys_len").alias("sys_len"), F.sum("ref_len").alias("ref_len"))
    if not by:  # one row each
        return sizes.withColumn("__one", F.lit(1)).join(hits.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return sizes.join(hits, by, "left").fillna(0)


def bleu_scores(stats: DataFrame, smooth: str = "exp", floor: float = 0.1, effective: bool = False) -> Column:
    """BLEU of a row of bleu_stats; smoothing `exp` or `floor`."""
    c, t = ([F.col(f"{x}{n}") for n in range(1, ORDER + 1)] for x in "ct")
    logs, alive = [], F.lit(True)
    for i in range(ORDER):
        alive = alive & (t[i] > 0)
        zeros = sum((F.when(c[j] == 0, 1).otherwise(0) for j in range(1, i + 1)), F.when(c[0] == 0, 1).otherwise(0))
        small = F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t[i]) if smooth == "exp" else F.lit(100.0 * floor) / t[i]
        p = F.when(c[i] == 0, small).otherwise(100.0 * c[i] / t[i])
        logs.append(F.when(alive, F.log(p)).otherwise(0.0 if effective else -9999999999.0))
    used = sum((F.when(t[i] > 0, 1).otherwise(0) for i in range(1, ORDER)), F.when(t[0] > 0, 1).otherwise(0)) if effective else F.lit(ORDER)
    brevity = F.when(F.col("sys_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.greatest(F.col("sys_len"), F.lit(1))))
    whole = logs[0] + logs[1] + logs[2] + logs[3]
    some = (c[0] > 0) | (c[1] > 0) | (c[2] > 0) | (c[3] > 0)
    return F.when((F.col("sys_len") > 0) & some, brevity * F.exp(whole / F.greatest(used, F.lit(1)))).otherwise(0.0)


def bleu(samples: DataFrame, keys: list[str], by: list[str], **options) -> DataFrame:
    stats = bleu_stats(samples, gram_counts(samples, keys), by)
    return stats.select(*by, bleu_scores(stats, **options).alias("bleu"))


def token_f1_rows(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f1): multiset token F1 in [0, 1], the best reference's."""
    long = samples.select(*keys, "sys", F.posexplode("refs").alias("ref_id", "ref"))
    both = long.select(*keys, "ref_id", F.size("sys").alias("n_sys"), F.size("ref").alias("n_ref"), F.explode_outer(F.concat(F.transform("sys", lambda x: F.struct(x.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("ref", lambda x: F.struct(x.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).alias("x"))
    per = both.groupBy(*keys, "ref_id", "n_sys", "n_ref", "x.t").agg(F.least(F.sum("x.a"), F.sum("x.b")).alias("m"))
    hit = per.groupBy(*keys, "ref_id", "n_sys", "n_ref").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("correct"))
    return hit.groupBy(*keys).agg(F.max(f1(ratio("correct", "n_sys"), ratio("correct", "n_ref"))).alias("f1"))


def fkgl(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = 0.39 * (n_words / F.greatest(n_sentences, F.lit(1))) + 11.8 * (n_syllables / F.greatest(n_words, F.lit(1))) - 15.59
    return F.when((n_words == 0) | (n_sentences == 0), 0.0).otherwise(F.greatest(F.lit(0.0), score))


def corpus_fkgl(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(by, fkgl) of rows of one or more sentences; a ratio of sums."""
    w = rows.select(*by, T.words(F.col(text)).alias("w")).select(*by, F.size("w").cast("long").alias("nw"), T.boundary_sentences(F.col("w")).cast("long").alias("ns"), T.syllables_of(F.col("w")).alias("ny"))
    sums = w.groupBy(*by).agg(F.sum("nw").alias("nw"), F.sum("ns").alias("ns"), F.sum("ny").alias("ny"))
    return sums.select(*by, fkgl(F.col("nw"), F.col("ns"), F.col("ny")).alias("fkgl"))


#: Versions that `baselines` makes of each row.
SYSTEMS = ("system", "Identity baseline", "Truncate baseline", "Reference*")


def baselines(rows: DataFrame, systems: tuple[str, ...] = SYSTEMS, low: bool = False) -> DataFrame:
    """Rows (.., orig, sys, refs) under system `system`, and as identity, truncate and, with two
    references or more, Reference* (the first against the others, the second twice).

    systems: those that are made. low: the texts in lower case, each gone over once.
    """
    ws = T.split_words(T.squeeze(F.col("orig")))
    cut = F.concat(F.array_join(F.slice(ws, 1, F.floor(F.size(ws) * 0.8).cast("int")), " "), F.lit("."))
    made = rows.withColumn("__cut", cut)
    if low:
        made = lowered(made).withColumn("__cut", F.lower("__cut"))
    versions = {
        "system": (F.col("sys"), F.col("refs")),
        "Identity baseline": (F.col("orig"), F.col("refs")),
        "Truncate baseline": (F.col("__cut"), F.col("refs")),
        "Reference*": (F.get("refs", F.lit(0)), F.concat(F.slice("refs", 2, 1), F.slice("refs", 2, F.greatest(F.size("refs") - 1, F.lit(1))))),
    }
    kept = F.array(*(F.struct(F.lit(v).alias("system"), s.alias("sys"), r.alias("refs")) for v, (s, r) in versions.items() if v in systems))
    if "Reference*" in systems:
        kept = F.filter(kept, lambda v: (v["system"] != "Reference*") | (F.size("refs") > 1))
    others = [c for c in rows.columns if c not in ("sys", "refs", "system")]
    return made.select(*others, F.inline(kept))


def leaderboard(rows: DataFrame, keys: list[str], low: bool = False) -> DataFrame:
    """(system, bleu, sari, fkgl, f1_token) in percent, two decimals; systems without any token or reference do not
    appear. A row is a sample of a system; low: its texts are in lower case."""
    every = row_sums(rows if low else lowered(rows), ["system"], whole=True)
    sums = [c for c in every.columns if c not in ("system", "f1")]
    s = every.groupBy("system").agg(*(F.sum(c).alias(c) for c in sums), (100 * F.avg("f1")).alias("f1_token"))
    s = s.where((F.col("grams") > 0) & F.col("f1_token").isNotNull())
    scores = {"bleu": bleu_scores(s), "sari": sari_of()[0], "fkgl": fkgl(F.col("sys_len"), F.col("n_sentences"), F.col("n_syllables")), "f1_token": F.col("f1_token")}
    return s.select("system", *(F.round(x, 2).alias(c) for c, x in scores.items()))


def relative_sari(row_scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, system, sari) with the ratio to the mean over systems of the row."""
    mean = F.avg("sari").over(Window.partitionBy(*keys))
    return row_scores.withColumn("relative", F.when(mean > 0, F.col("sari") / mean).otherwise(0.0))


def multiset_proportion(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Share of a's tokens beyond those of b, over the longer length."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest > 0, (F.size(a) - F.coalesce(shared_tokens(a, b) if shared is None else shared, F.size(a))) / longest).otherwise(0.0)


def quality_features(rows: DataFrame) -> DataFrame:
    """(orig, sys strings) with the features of referenceless quality estimation."""
    n = {c: T.normalize(F.col(c), lowercase=False) for c in ("orig", "sys")}
    done = rows.withColumns({f"__{c}": x for c, x in n.items()})
    done = done.withColumns({"__ow": T.split_words(F.col("__orig")), "__sw": T.split_words(F.col("__sys"))})
    done = done.withColumn("__both", shared_tokens(F.col("__ow"), F.col("__sw")))
    o, s = F.col("__orig"), F.col("__sys")
    longest = F.greatest(F.length(o), F.length(s))
    return done.withColumns({
        "compression": F.when(F.length(o) > 0, F.length(s) / F.length(o)).otherwise(0.0),
        "splits": T.boundary_sentences(F.col("__sw")) / F.greatest(T.boundary_sentences(F.col("__ow")), F.lit(1)),
        "edit_similarity": F.when(longest > 0, 1 - levenshtein(o, s) / longest).otherwise(1.0),
        "exact": F.when(o == s, 1.0).otherwise(0.0),
        "additions": multiset_proportion(F.col("__sw"), F.col("__ow"), F.col("__both")),
        "deletions": multiset_proportion(F.col("__ow"), F.col("__sw"), F.col("__both")),
    }).drop("__orig", "__sys", "__ow", "__sw", "__both")
