"""Exact repeated-passage removal: every byte that a 100-byte window covers which also
starts earlier in the corpus.

Equal windows have an equal smallest gram hash, so windows reduce to units: consecutive
windows of a text with the same (rightmost) smallest gram. Units meet by that hash:

1. units with the same hash and bytes form a class; all but its first are repeats whole;
2. first units of hashes with several classes are cut out of their texts, and a
   deep-shallow suffix sort of all their windows finds the equal ones among them;
3. a text's repeated windows, merged to runs, are what is removed from it.

Hot groups: tasks drop repeats of a class they see themselves before the exchange, so a
class has at most a row a chunk of text there. Hashes that a sample of the texts shows in
more than a millionth of all units (at least HEAVY) would gather many classes; their
windows become units of their own, keyed by 128 bits of their own hash, which spreads
them. That list has at most a million entries, eight bytes each. Neither changes the
result. Texts move once, compressed, into a bucketed table that both later joins read in
place.

Which windows are repeats is thus decided in two ways: of hashes whose units are all alike,
and of units within a class, by 128 bits of hash (64 of the smallest gram, 64 of the unit's
bytes); of the others by the suffix sort on the bytes. On sf0.01 292,717 windows (5,537 units)
fall to the first and 175,619 (4,638 units) to the sort. To send every unit's bytes to the sort
would move about seven times the input (135 bytes a unit of 36 new ones).

Intermediate tables stay until the session's owner removes them (`common.swept`), as the result
reads them. Null texts are empty. A null doc_id sorts last. Rows that share a doc_id follow each other
by a hash of their text; rows equal in both are judged as one, each with its result. Texts
below 100 bytes keep all. Only the id and text columns are read, so other columns may have any
name. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemeter.llm.common import byte_values, cut, scratch_path, scratch_table
from prosemeter.llm.suffixsort import sort_windows

WINDOW = 100
GRAM = 32
SPAN = WINDOW - GRAM + 1
#: Bytes of text hashed at a time, and units a task holds before it drops its own repeats.
PIECE = 1 << 19
CHUNK_UNITS = 600_000
#: Windows that one sort takes (a group is never split).
SORT_WINDOWS = 400_000
HEAVY = 500
SAMPLE = 8
LAST = (1 << 63) - 1
SEEDS = (0x51ED270B, 0xA2F9836E)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    h = b.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    s, c = 1, 0xD6E8FEB86659FD93
    while s < GRAM:
        h = h[:-s] * np.uint64(c) + h[s:]
        c, s = c * c % (1 << 64), 2 * s
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _slide(a: np.ndarray, n: int, of) -> np.ndarray:
    s = 1
    while 2 * s <= n:
        a, s = of(a[:-s], a[s:]), 2 * s
    return of(a[: len(a) - (n - s)], a[n - s :]) if n > s else a


def _anchors(h: np.ndarray) -> np.ndarray:
    """Position of the rightmost smallest gram of each window."""
    at, s, v = np.arange(len(h)), 1, h
    pick = lambda x, y, i, j: (np.where(y <= x, y, x), np.where(y <= x, j, i))
    while 2 * s <= SPAN:
        v, at = pick(v[:-s], v[s:], at[:-s], at[s:])
        s *= 2
    r = SPAN - s
    return pick(v[: len(v) - r], v[r:], at[: len(v) - r], at[r:])[1]


def units(buffer: bytes, starts: list[int], sizes: list[int]) -> tuple[np.ndarray, ...]:
    """(text, first window in the buffer, windows, gram hash) of the units of texts that lie
    one after another in a buffer."""
    none = np.zeros(0, dtype=np.int64)
    if len(buffer) < WINDOW or max(sizes, default=0) < WINDOW:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    h = gram_hashes(np.frombuffer(buffer, dtype=np.uint8))
    m = _slide(h, SPAN, np.minimum)
    edge = np.zeros(len(m) + 1, dtype=np.int8)
    long = [(s, s + z - WINDOW + 1) for s, z in zip(starts, sizes) if z >= WINDOW]
    edge[[a for a, _ in long]] += 1
    edge[[b for _, b in long]] -= 1
    valid = np.cumsum(edge[:-1]).astype(bool)
    high = _slide(np.concatenate([np.zeros(SPAN - 1, np.uint64), m, np.zeros(SPAN - 1, np.uint64)]), SPAN, np.maximum)
    change = m[1:] != m[:-1]
    if np.count_nonzero(high[: len(h)] == h) != 1 + np.count_nonzero(change):  # some window has its smallest gram twice
        at = _anchors(h)
        change = at[1:] != at[:-1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | change
    last = valid.copy()
    last[:-1] &= ~valid[1:] | change
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(np.array(starts), a, side="right") - 1, a, b - a, m[a]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """(buffer, starts, sizes, which texts), texts gathered to about PIECE bytes."""
    held, which, size = [], [], 0
    for k, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        held.append(t)
        which.append(k)
        size += len(t)
        if size >= PIECE:
            yield _joined(held, which)
            held, which, size = [], [], 0
    if held:
        yield _joined(held, which)


def _joined(held: list[bytes], which: list[int]) -> tuple[bytes, list[int], list[int], list[int]]:
    sizes = [len(t) for t in held]
    starts = [0, *np.cumsum(sizes)[:-1].tolist()]
    return b"".join(held), starts, sizes, which


_UNIT = ["k", "e", "doc", "pos", "n"]  # k: the gram hash of a first; n negative: a known repeat, under a key of its own


def _unit_rows(texts: list[bytes], docs: np.ndarray, marks: np.ndarray, heavy: np.ndarray) -> list[np.ndarray]:
    """Columns h, e, doc, pos, n of all units; pos has the text's mark above the offset."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    digest = xxhash.xxh3_64_intdigest
    for buffer, starts, sizes, which in _pieces(texts):
        text, a, n, h = units(buffer, starts, sizes)
        base = np.array(starts)
        if len(heavy) and len(h):
            hot = heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h
            if hot.any():  # a unit a window
                wide = n[hot]
                p = np.repeat(a[hot], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
                own = [buffer[i : i + WINDOW] for i in p.tolist()]
                text = np.concatenate([text[~hot], np.repeat(text[hot], wide)])
                a, n, h = np.concatenate([a[~hot], p]), np.concatenate([n[~hot], np.ones(len(p), np.int64)]), np.concatenate([h[~hot], np.array([digest(x, SEEDS[0]) for x in own], np.uint64)])
        e = np.fromiter((digest(buffer[i : i + j], SEEDS[1]) for i, j in zip(a.tolist(), (n + WINDOW - 1).tolist())), dtype=np.uint64, count=len(a))
        row = np.array(which)[text]
        for o, c in zip(out, (h.view(np.int64), e.view(np.int64), docs[row], marks[row] + a - base[text], n)):
            o.append(c.astype(np.int64))
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _spread(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (pos.view(np.uint64) >> np.uint64(12))
        return (x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _emit(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Firsts of the chunk's classes under their hash; the chunk's own repeats as known
    (n negative, neighbours merged), under a key of their own."""
    h, e, doc, pos, n = cols
    by = np.lexsort((pos, doc, e, h))
    h, e, doc, pos, n = (c[by] for c in (h, e, doc, pos, n))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (e[1:] == e[:-1])
    kept = ~again
    first = np.flatnonzero(kept)[np.cumsum(kept) - 1]
    again &= (doc != doc[first]) | (pos != pos[first])  # rows equal in id and text give the first's own place: no repeat
    d, p, w = doc[again], pos[again], n[again]
    by = np.lexsort((p, d))
    d, p, w = d[by], p[by], w[by]
    if len(d):
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + w[:-1])
        at = np.flatnonzero(new)
        # rows that repeat id and text give the same unit twice: the later end of the stretch counts
        stop = np.maximum.reduceat(p + w, at)
        d, p, w = d[at], p[at], stop - p[at]
    k = np.concatenate([h[kept], _spread(d, p)])
    zero = np.zeros(len(d), np.int64)
    data = (k, np.concatenate([e[kept], zero]), np.concatenate([doc[kept], d]), np.concatenate([pos[kept], p]), np.concatenate([n[kept], -w]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=_UNIT)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").to_numpy(), batch.column("mark").to_numpy().astype(np.int64) << 32


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units sorted by key, hash, bytes, place -> repeats (h null) and firsts to compare (with h)."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in _UNIT]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        k = cols[0]
        cut_at = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
        if cut_at:
            yield from _judge([c[:cut_at] for c in cols])
        held = [c[cut_at:] for c in cols]
    if held is not None and len(held[0]):
        yield from _judge(held)


def _judge(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    known = cols[-1] < 0
    yield _found(cols[2][known], cols[3][known], -cols[4][known], None)
    h, e, doc, pos, n = (c[~known] for c in cols)
    if not len(h):
        return
    new_h = np.ones(len(h), dtype=bool)
    new_h[1:] = h[1:] != h[:-1]
    new_e = new_h.copy()
    new_e[1:] |= e[1:] != e[:-1]
    first = np.flatnonzero(new_e)[np.cumsum(new_e) - 1]
    repeat = ~new_e & ((doc != doc[first]) | (pos != pos[first]))
    yield _found(doc[repeat], pos[repeat], n[repeat], None)
    group = np.cumsum(new_h) - 1
    several = (np.bincount(group, weights=new_e) > 1)[group] & new_e
    if several.any():
        yield _found(doc[several], pos[several], n[several], h[several])


_FOUND = pa.schema([("doc", pa.int64()), ("mark", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])


def _found(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, h: np.ndarray | None) -> pa.RecordBatch:
    last = pa.nulls(len(doc), pa.int64()) if h is None else pa.array(h)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((pos >> 32).astype(np.int32)), pa.array(pos & 0xFFFFFFFF), pa.array(n), last], schema=_FOUND)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut-out units sorted by hash -> stretches of windows that some earlier unit holds too."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(batch.column("n")).as_py()
        if size >= SORT_WINDOWS:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = whole.column("h").to_numpy()
            cut_at = int(np.searchsorted(h, h[-1], side="left"))
            if cut_at:
                yield from _sorted(whole.slice(0, cut_at))
            held = [whole.slice(cut_at)]
            size = pc.sum(held[0].column("n")).as_py()
    if held:
        yield from _sorted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _sorted(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    doc, mark, at, n, h = (rows.column(c).to_numpy() for c in ("doc", "mark", "at", "n", "h"))
    texts = byte_values(rows.column("bytes"))
    buffer = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    by = np.lexsort((at, mark, doc))
    new = np.ones(len(doc), dtype=np.int64)
    new[1:] = np.any([c[by][1:] != c[by][:-1] for c in (doc, mark, at)], axis=0)
    rank = np.empty(len(doc), dtype=np.int64)
    rank[by] = np.cumsum(new)  # rows equal in id and text cut out the same unit, which is one place
    unit = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, same = sort_windows(buffer, h[unit], base[unit] + inside, WINDOW)
    leaf = np.cumsum(~same) - 1
    place = (rank[unit] << 32) + inside
    low = np.full(leaf[-1] + 1 if len(leaf) else 0, LAST, dtype=np.int64)
    np.minimum.at(low, leaf, place[order])
    dup = np.zeros(len(unit), dtype=bool)
    dup[order] = place[order] != low[leaf]
    first = dup.copy()
    first[1:] &= ~dup[:-1] | (unit[1:] != unit[:-1])
    last = dup.copy()
    last[:-1] &= ~dup[1:] | (unit[1:] != unit[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    u = unit[a]
    yield pa.RecordBatch.from_arrays([pa.array(doc[u]), pa.array(mark[u]), pa.array(at[u] + inside[a]), pa.array(b - a + 1), pa.nulls(len(a), pa.int64())], schema=_FOUND)


def _removal(text: bytes, at: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """(bytes removed, runs, what is left, the runs) for repeated windows at..at+n."""
    by = np.argsort(at, kind="stable")
    a, b = at[by], (at + n + WINDOW - 1)[by]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > reach[:-1]
    starts = a[new].tolist()
    stops = reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist() if len(a) else []
    spans = list(zip(starts, stops))
    left, p = [], 0
    for x, y in spans:
        left.append(text[p:x])
        p = y
    left.append(text[p:])
    return sum(y - x for x, y in spans), len(spans), b"".join(left), spans


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept), a row for each row: spans
    as [first byte, last byte) pairs of the input, kept the bytes left."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = named.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)).cast("int").alias("mark"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    heavy = spark.sparkContext.broadcast(_heavy(src, max(HEAVY, total // 36 // 1_000_000)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            texts = byte_values(batch.column("text"))
            held.append(_unit_rows(texts, *_keys(batch), heavy.value))
            if sum(len(x[0]) for x in held) >= CHUNK_UNITS:
                yield _emit([np.concatenate(c) for c in zip(*held)])
                held = []
        if held:
            yield _emit([np.concatenate(c) for c in zip(*held)])

    made = src.select("doc", "mark", "text").mapInArrow(make, ", ".join(f"{c} long" for c in _UNIT))
    met = made.repartition("k").sortWithinPartitions("k", "e", "doc", "pos")
    kinds = "doc long, mark int, at long, n long, h long"
    judged = cut(met.mapInArrow(_classes, kinds), "units")

    # texts, compressed, in buckets that both joins below read without an exchange (with fewer buckets than
    # shuffle partitions Spark would deal them out anew)
    nb = buckets or int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-total // (64 << 20)))))
    table = scratch_table("texts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "mark")), pa.array([z.compress(t) for t in byte_values(batch.column("text"))], pa.binary())], names=["doc_id", "doc", "mark", "packed"])

    packed = src.mapInArrow(pack, "doc_id long, doc long, mark int, packed binary")
    packed.repartition(nb, "doc", "mark").write.bucketBy(nb, "doc", "mark").option("path", scratch_path(spark, "texts")).option("compression", "none").saveAsTable(table)
    texts = spark.table(table)

    wanted = judged.where("h is not null").groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "n", "h")).alias("units"))
    pieces = texts.select("doc", "mark", "packed").join(wanted.hint("shuffle_hash"), ["doc", "mark"]).mapInArrow(_cut_out, "doc long, mark int, at long, n long, h long, bytes binary")
    parts = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(_compare, kinds)
    repeats = judged.where("h is null").unionByName(parts).groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    return texts.join(repeats, ["doc", "mark"], "left").select("doc_id", "packed", "found").mapInArrow(_finish, out)


def _heavy(src: DataFrame, least: int) -> np.ndarray:
    """Gram hashes that a sample of the texts shows in at least `least` units, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(*p[:3])[3] for p in _pieces(byte_values(batch.column("text")))]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = src.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(SAMPLE)) == 0).select("text")
    often = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, least // SAMPLE)).select("h")
    return np.sort(np.array([r[0] for r in often.toLocalIterator()], dtype=np.int64).view(np.uint64))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        doc, mark = batch.column("doc").to_pylist(), batch.column("mark").to_pylist()
        rows, size = [], 0
        for k, (packed, wanted) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("units").to_pylist())):
            text = z.decompress(packed)
            for u in wanted:
                piece = text[u["at"] : u["at"] + u["n"] + WINDOW - 1]
                rows.append((doc[k], mark[k], u["at"], u["n"], u["h"], piece))
                size += len(piece)
            if size > 8 << 20:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc", "mark", "at", "n", "h", "bytes"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        found = batch.column("found")
        offsets = found.offsets.to_numpy()
        at, n = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
        rows = []
        for k, packed in enumerate(batch.column("packed").to_pylist()):
            text = z.decompress(packed)
            a, b = offsets[k], offsets[k + 1]
            removed, runs, kept, spans = _removal(text, at[a:b], n[a:b]) if b > a else (0, 0, text, [])
            rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), [{"start": x, "stop": y} for x, y in spans], kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
