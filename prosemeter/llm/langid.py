"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, in every slot, one bit a language; the slots that an
n-gram hashes to, combined by AND, give the mask of all languages that contain it. A
text's popcounts per language, corrected for each language's false positives (its share
of filled slots to the power of the hash functions), decide.

Fitting: at most about `rows_per_language` distinct labelled texts of each language, of the
`max_languages` languages with the most of them (documented bounds of the sample; texts are
chosen by their hash), counted in parallel; a character trigram seen `min_count` times belongs
to every language whose rate is at least `share` of its highest rate. Only the filter reaches
the driver. Empty tables: nothing is learned, or no rows come out.

Prediction reads the text alone, whole, in pieces of a bounded size. Null texts and texts
without a letter are `und` with score 0. With letters but no known n-gram the first
language in alphabetical order is returned, score 0. Nothing learned: all `und`. Ties go
to the first language in alphabetical order. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_LANGUAGE = 3000
MAX_LANGUAGES = 1000
SHARE = 0.5
MIN_COUNT = 3
SLOTS = 1 << 20
HASHES = 2
PIECE = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def points(text: str) -> np.ndarray:
    """Lower-cased code points, each run of other than letters one space."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.where(letters()[a], a, np.uint32(32))
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    return a[keep]


def grams(p: np.ndarray) -> np.ndarray:
    """Trigrams of code points as exact integers."""
    p = p.astype(np.uint64)
    return p[:-2] | (p[1:-1] << np.uint64(21)) | (p[2:] << np.uint64(42))


def pieces(text: str, size: int = PIECE) -> Iterator[np.ndarray]:
    """Trigrams of the whole text, from one bounded piece after another."""
    carry = np.array([32], dtype=np.uint32)
    for a in range(0, len(text), size):
        p = points(text[a : a + size])
        if carry[-1] == 32 and len(p) and p[0] == 32:
            p = p[1:]
        if a + size >= len(text) and (not len(p) or p[-1] != 32):
            p = np.append(p, np.uint32(32))
        p = np.concatenate([carry, p])
        if len(p) > 2:
            yield grams(p)
        carry = p[-2:]


def mixed(g: np.ndarray) -> np.ndarray:
    h = g * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Filter:
    """slots: a row a slot, a bit a language (words of 64 languages where there are more)."""

    languages: list[str]
    slots: np.ndarray
    hashes: int

    @classmethod
    def of(cls, members: dict[str, np.ndarray], slots: int = SLOTS, hashes: int = HASHES) -> Filter:
        names = sorted(members)
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(names) <= 8 * t().itemsize), np.uint64)
        table = np.zeros((-(-max(1, len(names)) // 64), slots), dtype=kind)
        made = cls(names, table, hashes)
        for k, name in enumerate(names):
            for at in made.at(np.asarray(members[name], dtype=np.uint64)):
                table[k // 64, at] |= kind(1 << (k % 64))
        return made

    def at(self, g: np.ndarray) -> Iterator[np.ndarray]:
        h = mixed(g)
        for i in range(self.hashes):
            yield ((h + np.uint64(i) * ((h >> np.uint64(40)) | np.uint64(1))) & np.uint64(self.slots.shape[1] - 1)).astype(np.int64)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """The languages containing each n-gram, a bit each (rows: words of 64 languages)."""
        at = list(self.at(g))
        out = self.slots[:, at[0]]
        for x in at[1:]:
            out = out & self.slots[:, x]
        return out

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Per-language popcounts over n-grams."""
        m = self.masks(g)
        one = m.dtype.type(1)
        return np.array([np.count_nonzero(m[k // 64] & (one << m.dtype.type(k % 64))) for k in range(len(self.languages))], dtype=np.int64)

    def false_rates(self) -> np.ndarray:
        one = self.slots.dtype.type(1)
        fill = [np.count_nonzero(self.slots[k // 64] & (one << self.slots.dtype.type(k % 64))) / self.slots.shape[1] for k in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def decide(self, text: str | None, rates: np.ndarray) -> tuple[str, float, float]:
        """(language, share of the corrected popcounts, corrected hits per n-gram)."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        total, hits, letter = 0, np.zeros(len(self.languages), dtype=np.int64), False
        for g in pieces(text):
            total += len(g)
            hits += self.hits(g)
            letter = letter or bool(((g >> np.uint64(21)) & np.uint64(0x1FFFFF) != 32).any() or (g & np.uint64(0x1FFFFF) != 32).any())
        if not letter and not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0
        right = np.clip((hits - total * rates) / (1 - rates), 0, None) if total else np.zeros(len(hits))
        best = int(np.argmax(right))
        whole = right.sum()
        return self.languages[best], float(right[best] / whole) if whole else 0.0, float(min(1.0, right[best] / total)) if total else 0.0


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, share: float = SHARE, min_count: int = MIN_COUNT) -> Filter:
    """(text, lang) -> Filter, from a bounded sample of the rows with both."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    rates = {lang: min(1.0, rows_per_language / max(1, n)) for lang, n in sizes.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not rates:
        return Filter.of({})
    of = F.create_map(*[F.lit(x) for item in rates.items() for x in item])
    draw = F.pmod(F.xxhash64(F.lit(97), "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(draw < of[F.col("lang")]).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                held.setdefault(lang, []).extend(pieces(text))
            for lang, parts in held.items():
                if parts:
                    code, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = F.sum("n").over(Window.partitionBy("lang"))
    rated = counted.where(F.col("n") >= min_count).withColumn("rate", F.col("n") / sums)
    high = rated.withColumn("high", F.max("rate").over(Window.partitionBy("gram")))
    own = high.where(F.col("rate") >= share * F.col("high"))
    members: dict[str, list[int]] = {lang: [] for lang in rates}
    for lang, gram in own.select("lang", "gram").toLocalIterator():
        members[lang].append(gram)
    return Filter.of({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in members.items()})


def predict(docs: DataFrame, model: Filter, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred, score, and hit_rate: the winner's corrected hits per n-gram; `prefix` goes
    before these names. Columns of these names are replaced."""
    made = [prefix + c for c in ("lang_pred", "score", "hit_rate")]
    docs = docs.drop(*made)
    schema = docs.withColumns(dict(zip(made, (F.lit("").cast("string"), F.lit(0.0), F.lit(0.0))))).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: slots times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rates = m.false_rates()
        for batch in batches:
            got = [m.decide(t, rates) for t in batch.column(text_col).to_pylist()]
            more = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *made])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
