"""Writers. Files appear by Spark's commit protocol or by a rename, never half written."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.operators.nested import drop_empty


def result_files(results: DataFrame, statistics: DataFrame, path: str, dataset: str, total: int) -> None:
    """results/ as JSON lines without empty fields, and statistics/ as one record."""
    drop_empty(results).write.mode("overwrite").json(f"{path}/results")
    stats = statistics.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("mean", "min", "max", "count")))).alias("statistics"))
    stats.select(F.lit(dataset).alias("dataset_path"), F.lit(total).alias("total_documents"), "statistics").write.mode("overwrite").json(f"{path}/statistics")


def request_file(requests: DataFrame, path: str) -> None:
    """One JSON request a line."""
    requests.select(F.to_json(F.struct(*requests.columns)).alias("value")).write.mode("overwrite").text(path)


def replaced(rows: DataFrame, path: str) -> None:
    """Rewrites a JSON folder as a whole: written beside it, the old one renamed aside, the new one
    renamed in, then the old one deleted; at every moment one of the two is there whole. A folder
    that an interrupted call left aside is put back first.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, here, aside = (jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", "", ".old"))
    fs = here.getFileSystem(conf)
    if fs.exists(aside) and not fs.exists(here):
        _rename(fs, aside, here)
    rows.write.mode("overwrite").json(f"{path}.new")
    fs.delete(aside, True)
    if fs.exists(here):
        _rename(fs, here, aside)
    _rename(fs, new, here)
    fs.delete(aside, True)


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"could not rename {a} to {b}")


def per_title(rows: DataFrame, path: str, title: str = "title") -> None:
    """A folder a title (with / and blanks as _)."""
    rows.withColumn("file_title", F.translate(title, " /", "__")).write.mode("overwrite").partitionBy("file_title").json(path)


def json_and_lines(rows: DataFrame, path: str) -> None:
    """The same records as JSON lines and as arrays, one array a file."""
    rows.write.mode("overwrite").json(f"{path}/lines")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).groupBy(F.spark_partition_id().alias("p")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).select("value").write.mode("overwrite").text(f"{path}/arrays")


def html_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as an HTML table, on the driver; one of over `most` rows says that it ends there."""
    got = rows.limit(most + 1).collect()
    more = f"<p>First {most} rows of more.</p>" if len(got) > most else ""
    got = got[:most]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in got)
    return f'<table class="table"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}'


def fixed_width(rows: DataFrame, most: int = 1000, places: int = 3) -> str:
    """A small result as a table of fixed width, on the driver; one of over `most` rows says that it ends there."""
    got = [["" if v is None else str(rounded(v, places)) for v in r] for r in rows.limit(most + 1).collect()]
    more = ["..."] if len(got) > most else []
    wide = [max(len(x) for x in column) for column in zip(rows.columns, *got[:most])]
    return "\n".join([" | ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in [rows.columns, ["-" * w for w in wide], *got[:most]]] + more)


def html_report(title: str, parts: dict[str, DataFrame], notes: str = "") -> str:
    """A page of tables: description, scores, scores by length, samples."""
    inner = "".join(f"<h2>{html.escape(name)}</h2>{html_table(df)}" for name, df in parts.items())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(notes)}</p>{inner}</body></html>'


def rounded(value, places: int = 3):
    """Numbers of a nested result, rounded."""
    if isinstance(value, float):
        return round(value, places)
    if isinstance(value, dict):
        return {k: rounded(v, places) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(rounded(v, places) for v in value)
    return value
