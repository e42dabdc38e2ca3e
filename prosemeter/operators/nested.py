"""Nested records: paths, key facts, sections, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prosemeter.functions import text as T

FACT = "struct<entity:string,behavior:string,context:string,priority:int>"
FACTS = f"array<{FACT}>"


# ------------------------------------------------------------------ paths


def resolve_path(schema: Ty.StructType, path: str) -> Column | None:
    """A dotted path against a schema, once, on the driver: the exact name first, then the shortest
    prefix that leads on, with backtracking. Keys of maps count as names. None if nothing fits."""
    if path in schema.fieldNames():
        return F.col(f"`{path}`")
    parts = path.split(".")

    def follow(kind: Ty.DataType, col: Column | None, at: int) -> Column | None:
        for i in range(at + 1, len(parts) + 1):
            name = ".".join(parts[at:i])
            if isinstance(kind, Ty.StructType) and name in kind.fieldNames():
                got, sub = (F.col(f"`{name}`") if col is None else col.getField(name)), kind[name].dataType
            elif isinstance(kind, Ty.MapType):
                got, sub = F.try_element_at(col, F.lit(name)), kind.valueType
                if i < len(parts) and not isinstance(sub, (Ty.StructType, Ty.MapType)):
                    continue
                # any name may be a key: the longest that leaves a path inside the values
                deeper = follow(sub, got, i) if i < len(parts) else got
                if deeper is not None:
                    return deeper
                continue
            else:
                continue
            if i == len(parts):
                return got
            deeper = follow(sub, got, i)
            if deeper is not None:
                return deeper
        return None

    return follow(schema, None, 0)


def blank(c: Column, kind: Ty.DataType) -> Column:
    """0, empty text, empty list and empty map count as missing."""
    if isinstance(kind, Ty.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, Ty.NumericType):
        return c.isNull() | (c == 0)
    if isinstance(kind, (Ty.ArrayType, Ty.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, Ty.BooleanType):
        return c.isNull() | ~c
    return c.isNull()


def get_path(df: DataFrame, path: str, default: Column | None = None) -> Column:
    """The value at a path; where it is blank or nowhere, the default, which must be of the value's
    type (without one: empty text for texts, else null)."""
    col = resolve_path(df.schema, path)
    if col is None:
        return F.lit("") if default is None else default
    kind = df.select(col.alias("x")).schema["x"].dataType
    if default is None:
        default = F.lit("") if isinstance(kind, Ty.StringType) else F.lit(None).cast(kind)
    return F.when(blank(col, kind), default).otherwise(col)


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Writes at a plainly split path, making the structs on the way."""
    first, *rest = path.split(".")
    if not rest:
        return df.withColumn(first, value)

    def put(col: Column | None, kind: Ty.DataType | None, names: list[str]) -> Column:
        inner_kind = kind[names[0]].dataType if isinstance(kind, Ty.StructType) and names[0] in kind.fieldNames() else None
        new = value if len(names) == 1 else put(col.getField(names[0]) if inner_kind is not None else None, inner_kind, names[1:])
        if not isinstance(kind, Ty.StructType):
            return F.struct(new.alias(names[0]))
        kept = [col.getField(n).alias(n) for n in kind.fieldNames() if n != names[0]]
        return F.struct(*kept, new.alias(names[0]))

    known = df.schema[first].dataType if first in df.columns else None
    return df.withColumn(first, put(F.col(f"`{first}`") if known is not None else None, known, rest))


def keyfact_path(path: str) -> str:
    """Where the key facts of the text at a path belong."""
    head, dot, _ = path.rpartition(".")
    return f"{head}.keyfacts" if dot else "generated_keyfacts"


#: Fixed value: the field of `analysis` that holds the relevance score.
RELEVANCE = "\u5185\u5bb9\u5173\u8054\u6027\u8bc4\u5206"
KNOWN_NAMES = ("popsci_article", "wikipedia_article", "source", "analysis", "original_data")


def detect_fields(schema: Ty.StructType) -> dict[str, str | None]:
    """Model, title and text fields by name: the model is the first field outside the known names;
    its text is `content`, else `text`."""
    model = next((f for f in schema.fields if f.name not in KNOWN_NAMES), None)
    kind = model.dataType if model is not None else None
    inner = kind.fieldNames() if isinstance(kind, Ty.StructType) else []
    field = next((n for n in ("content", "text") if n in inner), None)
    if model is None:
        return {"model": None, "text": None, "title": None}
    return {"model": model.name, "text": f"{model.name}.{field}" if field else model.name, "title": f"{model.name}.title" if "title" in inner else None}


def flatten_record(df: DataFrame, model: str | None = None) -> DataFrame:
    """The flat record of a nested one; `model` names the entry of `models` (the first if None)."""
    relevance = resolve_path(df.schema, f"original_data.analysis.{RELEVANCE}")
    root = "original_data.original_data"
    pick = F.map_entries("models")[0] if model is None else F.struct(F.lit(model).alias("key"), F.try_element_at("models", F.lit(model)).alias("value"))
    sides = [F.col(f"{root}.{article}.{c}").alias(f"{short}_{c}") for short, article in (("popsci", "popsci_article"), ("wiki", "wikipedia_article")) for c in ("title", "content", "url")]
    picked = df.withColumn("__m", pick)
    facts = resolve_path(df.schema, f"{root}.wikipedia_article.keyfacts")
    return picked.select(
        *sides, (F.coalesce(facts, F.array().cast(FACTS)) if facts is not None else F.array().cast(FACTS)).alias("wiki_keyfacts"), F.col(f"{root}.source").alias("source"),
        (relevance if relevance is not None else F.lit(None)).cast("int").alias("content_relevance_score"),
        F.col("__m.key").alias("model_name"), F.col("__m.value.title").alias("model_title"), F.col("__m.value.content").alias("model_output"),
    )


def drop_empty(df: DataFrame) -> DataFrame:
    """Nulls for empty text, lists, maps; 0 stays. The JSON writer then leaves the fields out."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, Ty.StringType):
            c = F.when(c != "", c)
        elif isinstance(f.dataType, (Ty.ArrayType, Ty.MapType)):
            c = F.when(F.size(c) > 0, c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def merged_maps(*maps: Column) -> Column:
    """Union of maps; of keys that several hold the last one counts, and null maps are empty."""
    pairs = F.flatten(F.array(*(F.coalesce(F.map_entries(m), F.array()) for m in maps)))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def is_subset(a: Column, b: Column) -> Column:
    """Every element of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def first_facts(*sources: Column) -> Column:
    """The first of several lists that is not null or empty."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in sources))


# ------------------------------------------------------------------ key facts


def facts_from_json(c: Column) -> Column:
    """A JSON list of facts, or an object that holds one under keyfacts, key_facts or as its first
    list; else an empty list."""
    bare = F.from_json(c, FACTS)
    fields = F.from_json(c, "map<string,string>")
    lists = F.filter(F.map_values(fields), lambda v: v.rlike(r"^\s*\["))
    named = F.coalesce(F.try_element_at(fields, F.lit("keyfacts")), F.try_element_at(fields, F.lit("key_facts")), F.get(lists, F.lit(0)))
    inner = F.when(c.rlike(r"^\s*\["), bare).otherwise(F.from_json(named, FACTS))
    return F.filter(F.coalesce(inner, F.array().cast(FACTS)), lambda x: x.isNotNull())


def unwrap_pairs(c: Column, depth: int = 5) -> Column:
    """Pairs [generated, truth] of an alignment reply, out of any extra nesting up to a depth."""
    text = T.strip_fences(c)
    out = F.array().cast(f"array<array<{FACT}>>")
    for d in range(2, depth + 1):
        kind = FACT
        for _ in range(d):
            kind = f"array<{kind}>"
        value = F.from_json(text, kind)
        for _ in range(d - 2):
            value = F.flatten(value)
        level = text.rlike(r"^\s*" + r"\[\s*" * d + r"\{")
        out = F.when(level, value).otherwise(out)
    return F.filter(F.coalesce(out, F.array().cast(f"array<array<{FACT}>>")), lambda p: F.size(p) >= 2)


def fact_key(c: Column) -> Column:
    """A fact as JSON with its fields in alphabetical order and nulls written."""
    return F.to_json(F.struct(c["behavior"].alias("behavior"), c["context"].alias("context"), c["entity"].alias("entity"), c["priority"].alias("priority")), {"ignoreNullFields": "false"})


def capped_ratio(hits: Column, total: Column) -> Column:
    """hits / total, at most 1; -1 without a total."""
    return F.when(total > 0, F.least(F.lit(1.0), hits / F.greatest(total, F.lit(1)))).otherwise(-1.0)


def alignment_scores(generated: DataFrame, truth: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, priority, precision, recall) from a judge's pairs; priority 0 is all of them.

    generated, truth: (keys, facts); pairs: (keys, group, reply), group the priority asked about.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        long = df.select(*keys, F.explode("facts").alias("f")).select(*keys, F.explode(F.array(F.lit(0), F.col("f.priority"))).alias("priority"))
        return long.groupBy(*keys, "priority").agg(F.count("*").alias(name))

    hit = pairs.select(*keys, F.col("group").alias("priority"), F.explode(unwrap_pairs(F.col("reply"))).alias("p"))
    hit = hit.groupBy(*keys, "priority").agg(F.countDistinct(fact_key(F.col("p")[0])).alias("g"), F.countDistinct(fact_key(F.col("p")[1])).alias("t"))
    grid = generated.select(*keys).union(truth.select(*keys)).distinct().select(*keys, F.explode(F.array(*map(F.lit, range(4)))).alias("priority"))
    on = [*keys, "priority"]
    j = grid.join(sizes(generated, "ng"), on, "left").join(sizes(truth, "nt"), on, "left").join(hit, on, "left").fillna(0, ["ng", "nt", "g", "t"])
    return j.select(*on, capped_ratio(F.col("g"), F.col("ng")).alias("precision"), capped_ratio(F.col("t"), F.col("nt")).alias("recall"))


def matched_scores(generated: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """The same from a deterministic one-to-one match on (entity, behavior), lower-cased and trimmed.

    Inputs: (keys, entity, behavior, priority). The k-th of equal facts meets the k-th, so matches are
    the smaller of two counts; nothing is joined pair by pair.
    """
    norm = lambda c: F.lower(T.squeeze(F.coalesce(F.col(c), F.lit(""))))
    side = lambda df, s: df.select(*keys, norm("entity").alias("e"), norm("behavior").alias("b"), "priority", F.lit(s).alias("s"))
    both = side(generated, 1).unionByName(side(truth, 0))
    long = both.select(*keys, "e", "b", "s", F.explode(F.array(F.lit(0), F.col("priority"))).alias("p"))
    per = long.groupBy(*keys, "p", "e", "b").agg(F.sum("s").alias("g"), F.sum(1 - F.col("s")).alias("t"))
    sums = per.groupBy(*keys, "p").agg(F.sum("g").alias("ng"), F.sum("t").alias("nt"), F.sum(F.least("g", "t")).alias("m"))
    return sums.select(*keys, F.col("p").alias("priority"), capped_ratio(F.col("m"), F.col("ng")).alias("precision"), capped_ratio(F.col("m"), F.col("nt")).alias("recall"))


# ------------------------------------------------------------------ questions and judges


def mcq_accuracy(questions: Column, answers: Column) -> Column:
    """Share of right answers (trimmed, upper case); 0 unless as many answers as questions, above 0."""
    tidy = lambda x: F.upper(T.strip(F.coalesce(x, F.lit(""))))
    right = F.size(F.filter(F.arrays_zip(F.transform(questions, lambda q: tidy(q["answer"])).alias("a"), F.transform(answers, tidy).alias("b")), lambda z: z["a"] == z["b"]))
    n = F.size(questions)
    return F.when((n > 0) & (F.size(answers) == n), right / F.greatest(n, F.lit(1))).otherwise(0.0)


def judge_score(reply: Column) -> Column:
    """The number after `Coherence:`, else a first lone digit 1 to 5, else null."""
    named = F.regexp_extract(reply, r"Coherence:\s*(\d+(\.\d+)?)", 1)
    digit = F.regexp_extract(reply, r"\b([1-5])\b", 1)
    return F.when(named != "", named.cast("double")).when(digit != "", digit.cast("double"))


def judged(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """(keys, score, n): mean of the parsed samples; -1 without one."""
    s = replies.select(*keys, judge_score(F.col(reply)).alias("s"))
    return s.groupBy(*keys).agg(F.coalesce(F.avg("s"), F.lit(-1.0)).alias("score"), F.count("s").alias("n"))


#: How replies write scores.
SCORE_LIST = r'"scores"\s*:\s*\[([^\]]+)\]'
SCORE_PAIR = r'"index"\s*:\s*(\d+)\s*,\s*"score"\s*:\s*(\d+)'


def parse_scores(reply: Column, expected: Column) -> Column:
    """Section scores of a reply, or null: the JSON field `scores`, else the first bracket after the
    word, else index/score pairs. One score too few is made up with 0; scores are 0 to 10."""
    text = T.strip_fences(reply)
    sized = lambda a: F.when(F.size(a) == expected, a).when(F.size(a) == expected - 1, F.concat(a, F.array(F.lit(0))))
    ranged = lambda a: F.when(F.forall(a, lambda x: x.isNotNull() & (x >= 0) & (x <= 10)), a)
    raw = F.from_json(F.get_json_object(text, "$.scores"), "array<string>")
    plain = F.when(F.forall(raw, lambda x: x.rlike(r"^-?\d+$")), F.transform(raw, lambda x: x.try_cast("int")))
    inside = F.regexp_extract(text, SCORE_LIST, 1)
    loose = F.when(inside != "", F.transform(F.regexp_extract_all(inside, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int")))
    index, score = (F.transform(F.regexp_extract_all(text, F.lit(SCORE_PAIR), F.lit(g)), lambda x: x.try_cast("int")) for g in (1, 2))
    pairs = F.reverse(F.filter(F.arrays_zip(index.alias("i"), score.alias("s")), lambda p: (p["s"] <= 10) & (p["i"] < expected)))
    indexed = F.transform(F.sequence(F.lit(0), F.greatest(expected - 1, F.lit(0))), lambda k: F.get(F.filter(pairs, lambda p: p["i"] == k), F.lit(0))["s"])
    full = F.when((expected > 0) & F.forall(indexed, lambda x: x.isNotNull()), indexed)
    return F.coalesce(ranged(sized(plain)), ranged(sized(loose)), full)


# ------------------------------------------------------------------ sections

#: Fixed value: a level-two heading on a line of its own.
HEADING = r"\n(==\s*[^=\n][^=\n]*\s*==)\n"


def sections(text: Column) -> Column:
    """Structs (heading, content) of a text with == headings == on lines of their own.

    Only level two counts; a heading at the very start has no line break before it and is none; of
    two on neighbouring lines the second is content, since they share one break. A blank lead is left
    out, blank sections are kept.
    """
    heads = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), T.strip)
    parts = F.transform(F.split(text, HEADING), T.strip)
    none = F.lit(None).cast("string")
    lead = F.when(parts[0] != "", F.array(F.struct(none.alias("heading"), parts[0].alias("content")))).otherwise(F.array().cast("array<struct<heading:string,content:string>>"))
    rest = F.transform(heads, lambda h, i: F.struct(h.alias("heading"), F.get(parts, i + 1).alias("content")))
    return F.concat(lead, rest)


def previews(parts: Column, limit: int = 2500) -> Column:
    return F.transform(parts, lambda s, i: F.struct(i.alias("index"), s["heading"].alias("heading"), T.preview(s["content"], limit, " ...[TRUNCATED]").alias("content_preview")))


def scored_sections(parts: Column, scores: Column) -> Column:
    """Sections and scores side by side, as JSON."""
    zipped = F.transform(parts, lambda s, i: F.struct(s["heading"].alias("heading"), s["content"].alias("content"), F.get(scores, i).alias("score")))
    return F.to_json(zipped, {"ignoreNullFields": "false"})


def substitute(text: Column, names: Column) -> Column:
    """Tokens replaced from a map by their upper-case form; replacements in lower case."""
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.lower(F.try_element_at(names, F.upper(t))), t)), " ")
