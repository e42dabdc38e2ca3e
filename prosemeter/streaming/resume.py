"""Request and response directories as streams: progress, resume and the polling loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosemeter.operators import exchange as X


def responses(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A file-source stream over a folder of response lines: each file is read once, when it appears."""
    return spark.readStream.schema(X.RESPONSE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def collect_scores(stream: DataFrame, target: str, checkpoint: str, parse=None) -> StreamingQuery:
    """Parsed replies appended to Parquet, a folder a batch; a batch that runs again rewrites its own
    folder, so every response counts once. Ends when no file is left."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reply = X.reply_text()
        rows = batch.select("custom_id", F.col("response.status_code").alias("status"), (parse(reply) if parse else reply).alias("value"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_missing(wanted: DataFrame, target: str) -> DataFrame:
    """Requests without a good reply so far."""
    done = wanted.sparkSession.read.parquet(target).where("status = 200 and value is not null")
    return X.pending(wanted, done, ["custom_id"])


def late_tolerant_counts(stream: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Replies per window and key, with a watermark so that state is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
