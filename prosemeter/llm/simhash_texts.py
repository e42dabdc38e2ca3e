"""SimHash near-duplicates whose links are verified by exact shingle similarity.

The wide form of the operator in `simhash`: a radius that holds nearly all pairs of a
Jaccard similarity of 0.8 is too wide for a filter by whole blocks of 64 bits, so

1. fingerprints are 128 bits of the distinct five-word shingles, and texts get into one
   set of tiles by MinHash bands (BANDS bands of ROWS minimums bring a pair of similarity
   0.8 together with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996, closer ones oftener);
2. tiles are compared by exclusive-or and bit counts as in `simhash`, tile pairs whose
   population counts differ beyond RADIUS skipped; at 0.8 the distance is 19.4 +- 4.1 bits,
   24 +- 4.4 for texts of four and five shingles;
3. what those links connect is a coarse group; in it the sets of shingles (64-bit hashes)
   are compared exactly, so only links of at least `similarity` count in the end.

Hot sets of tiles and large groups are split into parts whose pairs are dealt to tasks;
no task holds more than two parts, and each returns at most a link a text.

Equal texts collapse first and are named by XXH64 of the text; null and empty texts and
texts without words are equal to each other. A text of fewer words is one shingle. Only
the text column is read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.llm.common import byte_values, cut, groups, kept, swept
from prosemeter.llm.components import connected_components
from prosemeter.llm.simhash import _hash, deal, link_tile

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 36
BANDS = 20
ROWS = 5
#: Shingles whose minimums are taken at a time, and those that a part of a coarse group holds.
PIECE = 2048
PART_SHINGLES = 500_000
SPREAD_SHINGLES = 4000
ODD = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = text.lower().split()
    if len(words) < k:
        return np.array([_hash(b" ".join(words))], dtype=np.uint64)
    return np.unique(np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(k))))), dtype=np.uint64, count=len(words) - k + 1))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """128 bits, as two words: a bit is set where over half of the shingles' hashes set it."""
    ones = np.zeros(128, dtype=np.int64)
    for a in range(0, len(h), 8192):
        part = h[a : a + 8192]
        second = (part ^ (part >> np.uint64(31))) * ODD
        both = np.stack([part, second ^ (second >> np.uint64(29))], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(len(part), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(h), PIECE):
        low = np.minimum(low, (h[None, a : a + PIECE] * FACTORS[:, None]).min(axis=1))
    x = (low ^ (low >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return x.view(np.int64)


def verified(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first set that links of at least `similarity` reach from each set.

    From one text after another, all texts of a size that can be similar and that were not
    reached yet are compared at once.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    own = [ids[a:b] for a, b in zip(at, at[1:])]
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    left = np.arange(len(sizes))  # places in order of size not reached yet
    label = np.empty(len(sizes), dtype=np.int64)
    flat, starts = ids, at
    while len(left):
        members, queue = [left[0]], [left[0]]
        gone = np.zeros(len(left), dtype=bool)
        gone[0] = True
        n_left = sizes[left]
        while queue:
            x = queue.pop()
            lo, hi = np.searchsorted(n_left, [similarity * sizes[x] - 1e-9, sizes[x] / similarity + 1e-9], side="left")
            if lo >= hi or gone[lo:hi].all():
                continue
            mark[own[x]] = True
            both = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            mark[own[x]] = False
            hit = ~gone[lo:hi] & (both >= similarity * (sizes[x] + n_left[lo:hi] - both) - 1e-9)
            found = np.flatnonzero(hit) + lo
            gone[found] = True
            members += left[found].tolist()
            queue += left[found].tolist()
        place = order[np.array(members)]
        label[place] = place.min()
        flat = flat[np.repeat(~gone, n_left)]
        left = left[~gone]
        starts = np.concatenate([[0], np.cumsum(sizes[left])])
    return label


def _moved(names: np.ndarray, root: np.ndarray) -> pa.RecordBatch | None:
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], names=["a", "b"]) if len(moved) else None


def similar_texts(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) longs for each distinct text that has a near-duplicate: node is xxhash64 of
    the text, component the smallest node its links reach."""
    texts = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.sort(np.unique(batch.column("node").to_numpy(), return_index=True)[1])  # equal texts of a batch once
            sets = [shingles(t) for t in byte_values(batch.column("text").take(pa.array(keep)))]
            prints = np.array([wide_fingerprint(s) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            keys = np.concatenate([bands(s) for s in sets]) if sets else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep)), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), listed], names=["node", "n", "f0", "f1", "bands"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["band", "key", "i", "j"]):
            fps = np.stack([g.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")], axis=1)
            links = _moved(g.column("node").to_numpy(), link_tile(fps, RADIUS, g.column("n").to_numpy(), similarity))
            if links is not None:
                yield links

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["coarse", "i", "j"]):
            links = _moved(g.column("node").to_numpy(), verified([shingles(t) for t in byte_values(g.column("text"))], similarity))
            if links is not None:
                yield links

    with swept(docs.sparkSession):
        signed = cut(texts.mapInArrow(sign, "node long, n long, f0 long, f1 long, bands array<long>").dropDuplicates(["node"]), "signed")
        keyed = signed.select("node", "n", "f0", "f1", F.posexplode("bands").alias("band", "key"))

        tiles = deal(keyed, ["band", "key"], "node").select("band", "key", "i", "j", "node", "n", "f0", "f1")
        coarse = connected_components(tiles.mapInArrow(compare, "a long, b long")).withColumnRenamed("component", "coarse")
        members = cut(coarse.join(signed.select("node", "n"), "node"), "coarse")

        met = cut(texts.join(members.select("node"), "node").dropDuplicates(["node"]), "texts")
        dealt = deal(members, ["coarse"], "node", PART_SHINGLES, SPREAD_SHINGLES, "n").join(met, "node")
        pairs = dealt.select("coarse", "i", "j", "node", "text").repartition("coarse", "i", "j").sortWithinPartitions("coarse", "i", "j")
        return kept(connected_components(pairs.mapInArrow(verify, "a long, b long")), "similar")
