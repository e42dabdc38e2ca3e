"""Readers. Row order in a file is always explicit: whole files are split and numbered."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemeter.functions import text as T

SPLIT = "<::::>"


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON (an array, or a lone object as one row) or JSONL by extension; anything else is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format: {path}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, text): lines stripped, blank ones kept, a final line break opens no line."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n$", "").alias("v"))
    return whole.select(F.posexplode(F.split("v", r"\r?\n")).alias("row_id", "text")).select(F.col("row_id").cast("long").alias("row_id"), T.strip(F.col("text")).alias("text"))


def piped_lines(spark: SparkSession, stream: Iterable[str]) -> DataFrame:
    """(row_id, text) of lines piped to the driver (standard input), as `lines` has them."""
    return spark.createDataFrame([(i, x.rstrip("\r\n").strip()) for i, x in enumerate(stream)], "row_id long, text string")


def split_lines(spark: SparkSession, path: str, mark: str = SPLIT) -> DataFrame:
    """(row_id, parts): lines of sentences split by a mark."""
    return lines(spark, path).select("row_id", F.transform(F.split("text", mark), T.strip).alias("parts"))


def collapse(parts: Column) -> Column:
    return F.array_join(parts, " ")


def parallel(spark: SparkSession, sources: str, references: list[str], outputs: dict[str, str]) -> DataFrame:
    """(row_id, system, orig, sys, refs) of line-aligned files; unequal line counts are an error."""
    orig = lines(spark, sources).withColumnRenamed("text", "orig")
    refs = None
    for i, p in enumerate(references):
        one = lines(spark, p).withColumn("ref_id", F.lit(i))
        refs = one if refs is None else refs.unionByName(one)
    outs = None
    for name, p in outputs.items():
        one = lines(spark, p).select("row_id", F.lit(name).alias("system"), F.col("text").alias("sys"))
        outs = one if outs is None else outs.unionByName(one)
    n = orig.count()
    counts = {f"reference {r[0]}": r[1] for r in refs.groupBy("ref_id").count().collect()} | {f"system {r[0]}": r[1] for r in outs.groupBy("system").count().collect()}
    if wrong := {k: c for k, c in counts.items() if c != n}:
        raise ValueError(f"{n} source lines, but {wrong}")
    gathered = refs.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "text"))), lambda x: x["text"]).alias("refs"))
    return outs.join(orig, "row_id").join(gathered, "row_id")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headered, tab-separated, no quoting: index, label, sentence, POS and word index (the last column)."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def folds(spark: SparkSession, folder: str, k: int, split: str = "train") -> DataFrame:
    """The files {split}0.tsv .. of k folds, with a fold column."""
    out = None
    for i in range(k):
        one = tsv(spark, f"{folder}/{split}{i}.tsv").withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def papers(spark: SparkSession, path: str, which: str = "All") -> DataFrame:
    """JSON papers with the chosen bodies present: Paper_Body, News_Body, or All for both."""
    cols = {"Paper_Body": ["Paper_Body"], "News_Body": ["News_Body"], "All": ["Paper_Body", "News_Body"]}
    if which not in cols:
        raise ValueError(f"{which!r} is none of {sorted(cols)}")
    return records(spark, path).dropna(subset=cols[which]).select(*cols[which])


def titled_texts(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of whole files; the title is the file name up to its first dot."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.element_at(F.split(name, r"\."), 1).alias("title"), F.col("value").alias("text"))


def articles(rows: DataFrame, field: str) -> DataFrame:
    """(text) of a content field, stripped, blanks dropped."""
    return rows.select(T.strip(F.col(field)).alias("text")).where("text <> ''")


def article_pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(side, text) of records that have both texts."""
    both = rows.where((F.length(F.trim(F.col(first))) > 0) & (F.length(F.trim(F.col(second))) > 0))
    return both.select(F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col(first).alias("text")), F.struct(F.lit("b").alias("side"), F.col(second).alias("text")))))


def batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response JSONL, the last line of each custom_id."""
    from prosemeter.operators.exchange import RESPONSE, latest

    one = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line")).where("trim(line) <> ''")
    parsed = one.select("file", "at", F.from_json("line", RESPONSE).alias("r")).select("r.*", "file", "at")
    return latest(parsed, "custom_id", ["file", "at"]).drop("file", "at")


def facts_folder(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """(doc_id, title, ..) with the fact file of its title, else of its id, else the one at its place in
    the sorted listing."""
    files = titled_texts(spark, folder).withColumnRenamed("title", "stem")
    at = files.select("stem").distinct().select(F.col("stem").alias("place"), (F.row_number().over(Window.orderBy("stem")) - 1).alias("at"))  # file names alone
    named = docs.withColumns({"__t": T.file_title(F.col("title")), "__i": F.col("doc_id").cast("string")})
    pick = lambda key, out: files.select(F.col("stem").alias(key), F.col("text").alias(out))
    j = named.join(pick("__t", "__a"), "__t", "left").join(pick("__i", "__b"), "__i", "left").join(at, F.col("doc_id") == F.col("at"), "left").join(pick("place", "__c"), "place", "left")
    return j.withColumn("facts_json", F.coalesce("__a", "__b", "__c")).select(*docs.columns, "facts_json")
