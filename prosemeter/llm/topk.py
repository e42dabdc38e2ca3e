"""Exact top-k by inner product.

Queries come in blocks of a bounded size. For a block, each task multiplies the block's
matrix with tiles of its shard, selects k a tile, and merges into running lists; the
lists of all tasks then merge in a tree of fixed fan-in, so no task sees more than
fan-in times k rows of a query. Components become floor(256 * x) and products are exact
integers: float64 matrices while no sum can leave 53 bits, Python integers for the tiles
beyond, of any finite double. A score outside the range of a long is given as the end of
that range, and scores held so tie with each other.

Vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id. Other columns may have any name. A pair of unequal length is no candidate. Rows that repeat an id are all
candidates for other ids; asked, an id stands for its smallest vector. Empty vectors
score 0 with each other. No candidates or no queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemeter.llm.common import cut, scratch_path

K = 5
TILE = 1024
#: Queries with a component beyond this are multiplied apart from the others.
LARGE = 2.0**12
FAN_IN = 64
#: A block of queries is broadcast; this bounds it, and so what a task holds of it.
BLOCK_BYTES = 8 << 20
LONG = (-(1 << 63), (1 << 63) - 1)


def valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of a row's k largest scores, ties to smaller ids (ids ascending)."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > floor)
    level = np.flatnonzero(scores == floor)[: k - len(above)]
    keep = np.concatenate([above, level])
    return keep[np.lexsort((ids[keep], -scores[keep]))]


class Running:
    """A query block's lists, best first, over the tiles of one task."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, k: int):
        self.ids, self.block, self.k = ids, block, k
        self.lists: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.most = self.bound(block)
        self.small = np.floor(256.0 * block) if self.most < 2**52 else None

    @staticmethod
    def bound(x: np.ndarray) -> float:
        """No component of floor(256 * x) is larger."""
        with np.errstate(over="ignore"):
            return float(256.0 * np.abs(x).max(initial=0) + 1)

    def add(self, ids: np.ndarray, tile: np.ndarray) -> None:
        """Merges a tile in; rows whose products could leave 53 bits go apart, so that few are slow."""
        width = max(1, self.block.shape[1])
        wide = np.abs(tile).max(axis=1, initial=0) >= 2**52 / width / self.most / 256 - 1
        for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            if len(rows):
                order = rows[np.argsort(ids[rows], kind="stable")]
                self.merge(ids[order], self.scores(tile[order]))

    def scores(self, tile: np.ndarray) -> np.ndarray:
        if self.small is not None and self.block.shape[1] * self.most * self.bound(tile) < 2**52:
            return (self.small @ np.floor(256.0 * tile).T).astype(np.int64)
        exact = integers(self.block) @ integers(tile).T
        return np.array([min(max(x, LONG[0]), LONG[1]) for x in exact.ravel()], dtype=np.int64).reshape(exact.shape)

    def merge(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for q, row in enumerate(scores):
            held = self.lists[q]
            if len(held) == self.k and row.max(initial=LONG[0]) < held[-1][0]:
                continue
            own = ids == self.ids[q]
            if own.any():
                pick = np.flatnonzero(~own)[best(row[~own], ids[~own], self.k)]
            else:
                pick = best(row, ids, self.k)
            held += zip(row[pick].tolist(), ids[pick].tolist())
            held.sort(key=lambda x: (-x[0], x[1]))
            del held[self.k :]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python integers; doubles from 2**53 on are whole."""
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [int(v) * 256 if abs(v) >= 2**53 else floor(256.0 * v) for v in x.ravel().tolist()]
    return out


def by_length(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (row numbers, components as float64)."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = lists.offsets.to_numpy()[:-1]
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        at = (starts[rows][:, None] + np.arange(d)[None, :]).astype(np.int64)
        out[d] = (rows, values[at] if d else np.zeros((len(rows), 0)))
    return out


def search(queries: DataFrame, rows: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, v array<double>) of both sides -> (query_id, rank, vec_id, score)."""
    asked = cut(queries.where(valid(F.col("v")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, width = asked.agg(F.count("*"), F.sum(F.size("v") + 2)).first()
    blocks = -(-(8 * (width or 0)) // block_bytes) * 2 if 8 * (width or 0) > block_bytes else 1
    shards = rows.where(valid(F.col("v")) & F.col("vec_id").isNotNull())
    schema, path, found = "query_id long, task int, score long, vec_id long", scratch_path(queries.sparkSession, "tiles"), []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()
        if 8 * sum(map(len, mine.column("v").to_pylist())) > 4 * block_bytes:
            raise ValueError("a block of queries outgrew its bound; lower block_bytes")
        if not mine.num_rows:
            continue
        found.append(shards.mapInArrow(_tiles(mine, k), schema))
        if blocks > 1:  # each pass adds its lists to one folder
            found[-1].write.mode("append").option("compression", "zstd").parquet(path)
    if not found:
        return asked.selectExpr("vec_id query_id", "1 rank", "vec_id", "0L score").limit(0)
    return merge_tree(found[0] if blocks == 1 else queries.sparkSession.read.schema(schema).parquet(path), k)


def _tiles(block: pa.Table, k: int):
    ids = block.column("vec_id").to_numpy()
    vectors = block.column("v").chunk(0) if block.num_rows else block.column("v")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        running: dict[int, list[Running]] = {}
        for d, (at, q) in by_length(vectors).items():  # queries with large components apart: their products are the slow ones
            large = np.abs(q).max(axis=1, initial=0) > LARGE
            running[d] = [Running(ids[at[rows]], q[rows], k) for rows in (~large, large) if rows.any()]
        for batch in batches:
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for d, (at, x) in by_length(batch.column("v")).items():
                for r in running.get(d, ()):
                    for a in range(0, len(at), TILE):
                        r.add(own[at[a : a + TILE]], x[a : a + TILE])
        for r in (r for same in running.values() for r in same):
            got = [(int(q), s, v) for q, held in zip(r.ids, r.lists) for s, v in held]
            if got:
                q, s, v = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([task] * len(q), pa.int32()), pa.array(s, pa.int64()), pa.array(v, pa.int64())], names=["query_id", "task", "score", "vec_id"])

    return scan


def merge_tree(lists: DataFrame, k: int, fan_in: int = FAN_IN, levels: int = 3) -> DataFrame:
    """Top lists of tasks -> one a query, `fan_in` tasks a merge (the last level takes the rest)."""
    for level in range(1, levels + 1):
        group = F.floor(F.col("task") / fan_in) if level < levels else F.lit(0)
        own = lists.withColumn("task", group.cast("int"))
        ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "task").orderBy(F.desc("score"), "vec_id")))
        lists = ranked.where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_top_k(embeddings: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries: the rows whose id `every` divides; candidates: all other rows."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    return search(rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0), rows, k)
