"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64 bits from XXH64 (seed 42) of four-word shingles. Linking compares
distinct fingerprints in tiles of at most SIDE rows, with numpy exclusive-or and bit
counts; rows are sorted by population count, and a pair of tiles whose counts differ
beyond the radius is never compared. So that not all tiles meet, a filter that loses no
link comes first: fingerprints within the radius agree wholly on some choice of blocks
(`block_masks`), and only those that share such a block get into one set of tiles. A hot
block is split into parts, and its pairs of parts go to different tasks (`deal`), so a
task holds at most about 2 * PART_ROWS rows of it.

Equal fingerprints collapse before linking; a pair of parts returns at most one link a
row (to the first it can reach there), never its pairs. Nodes of the link graph order by
their smallest doc_id, so a component is named by its answer and no join gathers it.

Null and empty texts have fingerprint zero and link like any other. Rows repeat as often
as in the input. Rows with a null doc_id take part and never name a component; one of
null doc_ids only has a null component_id. Only the id and text columns are read, so
other columns may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemeter.llm.common import byte_values, cut, groups, kept, swept
from prosemeter.llm.components import connected_components

RADIUS = 4
WORDS_PER_SHINGLE = 4
SEED = 42
#: Rows that the average tile should have at most; decides the number of blocks.
TILE_ROWS = 4096
#: Rows of a side of a tile that is compared in one matrix.
SIDE = 512
#: Rows of a part of a hot block; a task compares two parts.
PART_ROWS = 4096
#: Rows of a key that make a part are the root of this times the rows.
SPREAD = 100

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, k: int = WORDS_PER_SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) < k:
        h = np.array([_hash(b" ".join(words))], dtype=np.uint64)
    else:
        h = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(k))))), dtype=np.uint64, count=len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 8192):
        part = h[a : a + 8192]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > len(h)).astype(object)).sum())


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in byte_values(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(make, f"doc_id {id_type.simpleString()}, fp long")


def block_masks(rows: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree wholly on one of them.

    b blocks, b - radius of them in a mask; b grows with the rows so that the average
    tile stays below `tile_rows`.
    """
    b = radius + 1
    while b < 64 and rows / 2 ** (64 * (b - radius) / b) > tile_rows and comb(b + 1, radius) <= 500:
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, b - radius)]


def link_tile(fps: np.ndarray, radius: int = RADIUS, sizes: np.ndarray | None = None, ratio: float = 0.0) -> np.ndarray:
    """The first row that each row reaches by links of at most `radius` bits, between sizes of at
    least `ratio` of each other. `fps`: uint64 rows, or rows of several words.
    """
    words = fps.reshape(len(fps), -1)
    pops = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    order = np.argsort(pops, kind="stable")
    f, p, n = words[order], pops[order], len(fps)
    label = np.arange(n)
    for i in range(0, n, SIDE):
        a = order[i : i + SIDE]
        for j in range(i, n, SIDE):
            if p[j] - p[min(i + SIDE, n) - 1] > radius:
                break  # nor can a later tile be within the radius
            b = order[j : j + SIDE]
            if (label[a] == label[a[0]]).all() and (label[b] == label[a[0]]).all():
                continue
            differ = sum(np.bitwise_count(f[i : i + SIDE, None, w] ^ f[None, j : j + SIDE, w]) for w in range(f.shape[1]))
            near = differ <= radius
            if sizes is not None:
                x, y = sizes[a][:, None], sizes[b][None, :]
                near &= np.minimum(x, y) >= ratio * np.maximum(x, y) - 1e-9
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            label = joined(label, a[x], b[y])
    return label


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links a - b, each the smallest row of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def deal(keyed: DataFrame, keys: list[str], name: str, rows: int = PART_ROWS, spread: int = SPREAD, weight: str = "1") -> DataFrame:
    """Rows whose key others share, with columns i and j: each pair of parts of a key's rows is
    one group by keys, i and j. Parts hold at most about `rows` rows (or sums of `weight`), and
    there are about sqrt(rows of the key / `spread`) at least, so that a hot key spreads over
    tasks long before that; `name` deals.
    """
    held = F.sum(F.expr(weight))
    parts = F.greatest(F.ceil(held / rows), F.floor(F.sqrt(held / spread))).cast("int")
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1")
    met = keyed.join(cut(sizes.drop("n"), "sizes"), keys)
    own = F.pmod(F.xxhash64(name), F.greatest(F.col("parts"), F.lit(1))).cast("int")
    met = met.withColumn("own", own)
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1), lambda p: F.struct(F.least("own", p).alias("i"), F.greatest("own", p).alias("j"))), lambda x: x.i < x.j)
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = met.withColumn("pair", F.explode(F.when(F.col("parts") < 2, alone).otherwise(pairs)))
    return dealt.select("*", "pair.i", "pair.j").drop("pair", "own", "parts").repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def link(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Distinct (fp, first_id) -> links (a, b) of structs (unnamed, first_id, fp): enough of them to
    connect all that links connect."""
    masks = block_masks(distinct.count(), radius, tile_rows)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", "first_id", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "tile"))
    kind = distinct.schema["first_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["mask", "tile", "i", "j"]):
            fps = g.column("fp").to_numpy().view(np.uint64)
            root = link_tile(fps, radius)
            moved = np.flatnonzero(root != np.arange(len(fps)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([g.column(c).combine_chunks().take(pa.array(at)) for at in (root[moved], moved) for c in ("first_id", "fp")], names=["a_id", "a_fp", "b_id", "b_fp"])

    found = deal(keyed, ["mask", "tile"], "fp", part_rows).select("mask", "tile", "i", "j", "fp", "first_id").mapInArrow(compare, f"a_id {kind}, a_fp long, b_id {kind}, b_fp long")
    return found.select(*(node(f"{x}_id", f"{x}_fp").alias(x) for x in "ab"))


def node(first_id: str, fp: str) -> Column:
    """Named ones first, by their id."""
    return F.struct(F.col(first_id).isNull().alias("unnamed"), F.col(first_id).alias("first_id"), F.col(fp).alias("fp"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`."""
    marked = cut(fingerprints(docs, text_col, id_col), "fingerprints")
    with swept(docs.sparkSession):
        distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        parts = connected_components(link(distinct, radius, tile_rows)).select(F.col("node.fp").alias("fp"), "component")
        answer = F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component.first_id"))
        by_fp = kept(distinct.join(parts, "fp", "left").select("fp", answer.alias("component_id")), "components")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
