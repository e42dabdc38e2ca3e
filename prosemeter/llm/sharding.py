"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters whole records into memory-sized buckets by a seeded hash; pass two
sorts each bucket, shuffles it by Fisher-Yates with a generator seeded by the bucket,
and numbers it from the bucket's offset. Position p of the shuffled order goes to shard
p mod shards, slot p div shards: counts differ by at most one (law `rows`).

The number of buckets follows from the bytes of the input; their counts, eight bytes
each, are all that reaches the driver. The hash takes id, text and size, so groups of
equal texts spread over buckets; only rows that repeat id and text share one. Where such
rows alone would overfill a bucket, they are numbered and scattered by their numbers
(`_scatter_repeats`); as they are alike, which of them gets which place is left open. Null
texts have size 16 and crc 0; null ids hash like a value of their own. Rows repeat as
often as in the input, further columns travel with their rows, ones named
size, shard or slot are replaced. An empty table gives an empty table. Fewer rows than shards
leave the last shards empty. The same rows and seed always give the same shards.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemeter.llm.common import cut, n_bytes

SHARDS = 40
BUCKET_BYTES = 32 << 20
#: So many buckets at least, so that a small table spreads over tasks.
MIN_BUCKETS = 64
#: Rows that repeat id and text and are more than a bucket's mean times this are scattered by number.
HOT = 4
SEED = 1729
#: Fixed by the contract: what each record counts besides its text.
RECORD_BYTES = 16


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with columns size, shard and slot added, bucket by bucket in shuffled order."""
    docs = docs.drop("size", "shard", "slot", "__bucket", "__mixed")
    sized = docs.withColumn("size", n_bytes(F.col(text_col)) + RECORD_BYTES)
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-int(total) // bucket_bytes))
    mixed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col("size"))
    scattered = sized.withColumns({"__mixed": mixed, "__bucket": F.pmod(mixed, F.lit(buckets)).cast("int")})
    counts = _counts(scattered, buckets)
    most = max(MIN_BUCKETS, HOT * -(-sum(counts) // buckets))
    if max(counts) > most:
        scattered = _scatter_repeats(scattered, [b for b, n in enumerate(counts) if n > most], most, buckets)
        counts = _counts(scattered, buckets)
    scattered = scattered.drop("__mixed")
    offsets = np.array([0, *accumulate(counts)], dtype=np.int64)
    names = [*docs.columns, "size", "shard", "slot"]
    types = {f.name: f.dataType.simpleString() for f in sized.schema.fields}
    schema = ", ".join(f"`{c}` {types.get(c, 'int' if c == 'shard' else 'long')}" for c in names)

    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        b = key[0].as_py()
        by = [(id_col, "ascending"), (text_col, "ascending")]
        order = pc.sort_indices(bucket, sort_keys=by).to_numpy().copy()
        rng = np.random.Generator(np.random.PCG64([seed, b]))
        for i in range(len(order) - 1, 0, -1):  # Fisher-Yates
            j = rng.integers(0, i + 1)
            order[i], order[j] = order[j], order[i]
        out = bucket.take(pa.array(order))
        at = np.arange(len(order), dtype=np.int64) + offsets[b]
        out = out.append_column("shard", pa.array((at % shards).astype(np.int32))).append_column("slot", pa.array(at // shards))
        return out.select(names)

    return scattered.groupBy("__bucket").applyInArrow(shuffle, schema)


def _counts(scattered: DataFrame, buckets: int) -> list[int]:
    counts = [0] * buckets
    for b, n in scattered.groupBy("__bucket").count().toLocalIterator():
        counts[b] = n
    return counts


def _scatter_repeats(scattered: DataFrame, full: list[int], most: int, buckets: int) -> DataFrame:
    """Rows whose hash over `most` rows share get a bucket by hash and number. The hashes are fewer
    than the buckets. Numbers are a row's place in its input partition after those of the partitions
    before, so that no task sees more of them than a partition holds; hash and count alone decide
    how many go to which bucket.
    """
    inside = scattered.where(F.col("__bucket").isin(full))
    hot = inside.groupBy("__mixed").count().where(F.col("count") > most).select("__mixed")
    hot = cut(hot, "hot")
    parted = cut(scattered.join(hot, "__mixed").withColumn("__part", F.spark_partition_id()), "repeats")
    sizes = parted.groupBy("__mixed", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__mixed").orderBy("__part")) - F.col("__n")
    place = F.row_number().over(Window.partitionBy("__mixed", "__part").orderBy(F.lit(0)))
    numbered = parted.withColumn("__i", place).join(sizes.select("__mixed", "__part", before.alias("__before")), ["__mixed", "__part"])
    spread = numbered.withColumn("__bucket", F.pmod(F.xxhash64("__mixed", F.col("__i") + F.col("__before")), F.lit(buckets)).cast("int"))
    return scattered.join(hot, "__mixed", "left_anti").unionByName(spread.select(scattered.columns))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The second pass's output as Parquet, a folder a shard."""
    external_shuffle(docs, **options).write.partitionBy("shard").parquet(path)
