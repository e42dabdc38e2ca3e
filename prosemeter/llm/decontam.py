"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased word runs. Each fixed mask hashes the tokens at its positions and
ignores the others, so a hit survives substitutions there; the two masks of MASKS together
hit every overlap of at least MIN_TOKENS tokens with at most a fifth of them substituted
(a test proves it for 13 to 200 tokens). A hit fixes an alignment (diagonal) of item and
document; on it the longest overlap is taken that starts and ends on equal tokens, has at
least `similarity` of them equal and at least MIN_TOKENS tokens. An item of fewer than
MIN_TOKENS tokens has masks of its own (LIGHT, proved for 4 to 12 tokens) and needs an
overlap of `similarity` of its tokens; one of up to three tokens must stand there word
for word.

Benchmark items are broadcast in blocks of at most BLOCK_TOKENS tokens, one narrow pass
over the documents a block; documents are never shuffled. Null and empty texts and items
without a token give no rows. Rows that repeat a doc_id are searched each; of rows that
repeat an item, and of several places in a document, the longest overlap counts, of equal
ones the first. Hot passages cost a row per document and item; a token repeated over and
over costs its runs, not their pairs. Only doc_id, text and item_id are read, so other
columns may have any name, those of the result too. An empty table on either side gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.llm.common import cut

#: Positions a mask looks at; between them are positions that it ignores.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 3, 4, 5))
#: For items of fewer than MIN_TOKENS tokens.
LIGHT = ((0, 1, 3), (0, 2, 3))
MIN_TOKENS = 13
SIMILARITY = 0.8
BLOCK_TOKENS = 200_000
#: Pairs of runs with equal hashes that are looked at together.
PAIRS = 1 << 20
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks that search for an item of n tokens."""
    return MASKS if n >= MIN_TOKENS else LIGHT if n > 3 else (tuple(range(n)),)


def runs(h: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches in which hash (and `same`) stay and places follow each other."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(h)) - 1


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] of them, then those from lo[1], and so on."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """Spaced-seed hashes of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, ws) for i, ws in ((i, tokens(t)) for i, t in items) if ws]
        self.ids = [i for i, _ in kept]
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64) for _, ws in kept]
        rng = np.random.Generator(np.random.PCG64(11))
        self.factors = rng.integers(0, 1 << 63, size=8, dtype=np.uint64) | np.uint64(1)
        by_mask: dict[tuple[int, ...], list[int]] = {}
        for k, x in enumerate(self.items):
            for mask in masks_for(len(x)):
                by_mask.setdefault(mask, []).append(k)
        #: By mask: hash, item, first and last place of each run of equal hashes, by hash.
        self.tables = {mask: self.table(mask, own) for mask, own in by_mask.items()}

    def table(self, mask: tuple[int, ...], own: list[int]) -> tuple[np.ndarray, ...]:
        at = [np.arange(max(0, len(self.items[k]) - mask[-1])) for k in own]
        h = np.concatenate([self.hashes(self.items[k], mask, a) for k, a in zip(own, at)])
        item = np.repeat(np.array(own, dtype=np.int64), [len(a) for a in at])
        place = np.concatenate(at)
        first, last = runs(h, place, item)
        order = np.argsort(h[first], kind="stable")
        return h[first][order], item[first][order], place[first][order], place[last][order]

    def hashes(self, x: np.ndarray, mask: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for c, o in zip(self.factors, mask):
            h = (h ^ (x[at + o].astype(np.uint64) * c)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Item -> document positions of the item's first token, of every alignment hit."""
        known, wide, found = x > 0, 2 * len(x) + 2 * max(map(len, self.items), default=0) + 2, np.zeros(0, np.int64)
        for mask, (h, item, a, b) in self.tables.items():
            n = len(x) - mask[-1]
            if n <= 0:
                continue
            care = known[:n].copy()
            for o in mask[1:]:
                care &= known[o : o + n]
            pos = np.flatnonzero(care)
            if not len(pos):
                continue
            own = self.hashes(x, mask, pos)
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            some = hi > lo
            pos, own, lo, hi = pos[some], own[some], lo[some], hi[some]
            if not len(pos):
                continue
            first, last = runs(own, pos)
            c, d, lo, n_of = pos[first], pos[last], lo[first], (hi - lo)[first]
            ends = np.cumsum(n_of)
            start = 0
            while start < len(c):  # pieces of a bounded number of pairs
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                part = slice(start, stop)
                row = ranges(lo[part], n_of[part])
                low = np.repeat(c[part], n_of[part]) - b[row]
                high = np.repeat(d[part], n_of[part]) - a[row]
                count = high - low + 1
                code = ranges(item[row] * wide + low + wide // 2, count)
                found = np.unique(np.concatenate([found, code]))
                start = stop
        which = found // wide
        cuts = np.flatnonzero(np.diff(which)) + 1
        return {int(p[0] // wide): p % wide - wide // 2 for p in np.split(found, cuts) if len(p)}

    def overlaps(self, text: str | None, similarity: float, least: int, shortest: int = 1) -> list[tuple[int, int, int, int]]:
        """(item_id, first token, tokens, equal tokens): the longest overlap with each item of
        at least `shortest` tokens."""
        words = tokens(text)
        x = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        best: dict[int, tuple[int, int, int]] = {}
        for k, starts in self.hits(x).items():
            y = self.items[k]
            if len(y) < shortest:
                continue
            need = min(least, len(y)) if len(y) >= MIN_TOKENS else ceil(similarity * len(y) - 1e-9)
            a, b = np.maximum(0, -starts), np.minimum(len(y), len(x) - starts)
            held = best.get(self.ids[k], (need, -len(x), 0))
            for i in np.lexsort((starts + a, a - b)).tolist():  # the longest that can be first
                room, first = int(b[i] - a[i]), int(starts[i] + a[i])
                if room < held[0]:
                    break
                if room == held[0] and first > -held[1]:
                    continue
                equal = y[a[i] : b[i]] == x[first : first + room]
                if np.count_nonzero(equal) < similarity * held[0] - 1e-9:
                    continue
                got = longest(equal, similarity)
                if got and got[1] - got[0] >= need:
                    held = max(held, (got[1] - got[0], -(first + got[0]), got[2]))
                    best[self.ids[k]] = held
        return [(i, -s, n, e) for i, (n, s, e) in best.items()]


def longest(equal: np.ndarray, similarity: float) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) of the longest stretch that starts and ends on equal tokens
    and has at least `similarity` of them equal; the first of equal length."""
    on = np.flatnonzero(equal)
    if not len(on):
        return None
    done = np.concatenate([[0], np.cumsum(equal)])
    score = done - similarity * np.arange(len(equal) + 1)
    low = np.minimum.accumulate(score[on])  # smallest score at a start up to here
    at = np.searchsorted(-low, -(score[on + 1] + 1e-9), "left")  # of each end: the first start that serves
    ends = on[at < len(on)]
    starts = on[at[at < len(on)]]
    size = np.where(starts <= ends, ends + 1 - starts, 0)
    if not size.max(initial=0):
        return None
    s = int(starts[size == size.max()].min())
    e = s + int(size.max())
    return s, e, int(done[e] - done[s])


def _items(benchmark: DataFrame, block_tokens: int) -> tuple[DataFrame, int]:
    """The items that can be searched, and the number of blocks they make."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    words = items.agg(F.sum(F.floor((F.length("text") + 1) / 2))).first()[0] or 0  # as many tokens at most
    return items, 1 if words <= block_tokens else -(-words // block_tokens) * 2


def _block(items: DataFrame, blocks: int, b: int) -> Index:
    return Index([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()])


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least: int = MIN_TOKENS, block_tokens: int = BLOCK_TOKENS, shortest: int = 1) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> (doc_id, item_id, first_token, n_tokens, n_equal,
    similarity), a row for each document and item of at least `shortest` tokens that overlap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", "text")
    parts = []
    items, blocks = _items(benchmark, block_tokens)
    for b in range(blocks):
        index = _block(items, blocks, b)
        part = src.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(index), similarity, least, shortest), f"doc_id {kind}, item_id long, first_token long, n_tokens long, n_equal long")
        parts.append(cut(part, "overlaps") if blocks > 1 else part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("similarity", F.round(F.col("n_equal") / F.col("n_tokens"), 6))


def _search(shared, similarity: float, least: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                got = index.overlaps(text, similarity, least, shortest)
                ids += [k] * len(got)
                rows += got
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4))], names=["doc_id", "item_id", "first_token", "n_tokens", "n_equal"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least: int = MIN_TOKENS, block_tokens: int = BLOCK_TOKENS, shortest: int = 5) -> DataFrame:
    """The documents without an overlap, all columns kept; each row is judged by its own text.
    Items of fewer than `shortest` tokens are common phrases and drop no document."""
    items, blocks = _items(benchmark, block_tokens)
    for b in range(blocks):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(_block(items, blocks, b)), similarity, least, shortest), docs.schema)
        docs = cut(docs, "clean") if b < blocks - 1 else docs
    return docs


def _clean(shared, similarity: float, least: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not index.overlaps(t, similarity, least, shortest) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run
