"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; dealt out where its files give fewer tasks than there are cores (a small table in
    one row group). Larger inputs are read as they lie."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "embeddings") and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on a local master without that setting (one machine, tests) a temporary folder is
    made, once a session; a cluster without it is refused.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("spark.prosemeter.scratch", "")
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="prosemeter-")
        spark.conf.set("spark.prosemeter.scratch", own)
    return own


#: Paths and tables that this driver has made and not removed, in order.
MADE: list[str] = []
#: Of those, results that the next sweep to end leaves.
KEPT: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    MADE.append(f"{shared_dir(spark)}/prosemeter/{label}-{uuid.uuid4().hex}")
    return MADE[-1]


def scratch_table(label: str) -> str:
    MADE.append(f"prosemeter_{label}_{uuid.uuid4().hex}")
    return MADE[-1]


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch paths and tables made inside, but for what `kept` wrote, which is left to
    the sweep around this one. For steps whose result is written before the end."""
    before = len(MADE)
    try:
        yield
    finally:
        mine, MADE[before:] = MADE[before:], [x for x in MADE[before:] if x in KEPT]
        for name in mine:
            if name in KEPT:
                KEPT.remove(name)
            elif "/" in name:
                remove(spark, name)
            else:
                spark.sql(f"DROP TABLE IF EXISTS {name}")


def kept_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `written`, for a result that outlives the sweep around it."""
    out, path = written(df, label)
    KEPT.add(path)
    return out, path


def kept(df: DataFrame, label: str) -> DataFrame:
    return kept_at(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: lineage ends here and a lost
    executor costs a re-read, not a recomputation. Also the path, for `remove`."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal integer `keys`, from batches sorted by
    them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


