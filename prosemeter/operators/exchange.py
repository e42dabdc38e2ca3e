"""Request and response tables: what is asked, what came back, what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST = "custom_id string, method string, url string, body struct<model:string,messages:array<struct<role:string,content:string>>,temperature:double>"
RESPONSE = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>"


def requests(rows: DataFrame, custom_id: Column, prompt: Column, model: str, temperature: float = 0.0, url: str = "/v1/chat/completions") -> DataFrame:
    """(custom_id, method, url, body) of one user message a row."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"), F.lit(float(temperature)).alias("temperature"))
    return rows.select(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a finished counterpart: what a resumed run still has to ask."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(responses: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last response of each key; `order` says what is later."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return responses.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """(key, attempt, error, ..): the latest attempt without an error, else the latest."""
    w = Window.partitionBy(key).orderBy(F.col("error").isNotNull(), F.desc("attempt"))
    return attempts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def reply_text(response: str = "response") -> Column:
    return F.get(F.col(f"{response}.body.choices"), F.lit(0))["message"]["content"]


def merged(asked: DataFrame, responses: DataFrame, strict: bool = True) -> DataFrame:
    """Requests with their reply text. Missing and failed ones raise, or with strict=False have a
    null reply and say why in `problem`."""
    j = asked.join(responses.select("custom_id", F.col("response.status_code").alias("__status"), reply_text().alias("reply"), F.lit(True).alias("__there")), "custom_id", "left")
    problem = F.when(F.col("__there").isNull(), "missing").when(~F.col("__status").eqNullSafe(F.lit(200)), F.concat(F.lit("status "), F.coalesce(F.col("__status").cast("string"), F.lit("none")))).when(F.col("reply").isNull(), "malformed")
    out = j.withColumn("problem", problem).drop("__status", "__there")
    if strict:
        return out.withColumn("reply", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("no usable response for"), "custom_id", F.col("problem")))).otherwise(F.col("reply"))).drop("problem")
    return out.withColumn("reply", F.when(F.col("problem").isNull(), F.col("reply")))


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with changed columns replaced where a change is there."""
    cols = [c for c in changes.columns if c != key]
    j = rows.join(changes.select(key, F.struct(*cols).alias("__new")), key, "left")
    return j.select(*(F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns))


def attach(rows: DataFrame, key: str, *scores: DataFrame) -> DataFrame:
    """Score tables joined to their rows one after the other."""
    for s in scores:
        rows = rows.join(s, key, "left")
    return rows
