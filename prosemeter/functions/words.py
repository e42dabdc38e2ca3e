"""Word-pair functions that need a dynamic programme or a greedy walk: Arrow-batched UDFs over
one row's words each, so memory follows the longest row."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# types as objects: workers import this module, and have no session to parse DDL with
PAIRS = Ty.ArrayType(Ty.StructType([Ty.StructField("a", Ty.IntegerType()), Ty.StructField("b", Ty.IntegerType())]))
WORDS = Ty.ArrayType(Ty.StringType())
LABELLED = Ty.StructType([Ty.StructField("source", WORDS), Ty.StructField("target", WORDS)])

#: English stop words that alignment treats apart.
STOP = frozenset("a an the and or but if of at by for with about to from in on is are was were be been being it its this that these those as not no".split())
PUNCTUATION = frozenset(".,;:!?()[]{}'\"`-")


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Equal last words always pair; on a tie the end of
    the first list is dropped."""
    n, m = len(a), len(b)
    above = np.zeros(m + 1, dtype=np.int32)
    up = np.zeros((n + 1, m // 8 + 1), dtype=np.uint8)  # a bit a cell: the end of the first list is dropped
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[w] for w in b], dtype=np.int64)
    for i in range(1, n + 1):
        same = y == codes[a[i - 1]]
        # a row of the table: diagonal + 1 where equal, else the larger neighbour, left to right
        row = np.zeros(m + 1, dtype=np.int32)
        row[1:] = np.maximum.accumulate(np.where(same, above[:-1] + 1, above[1:]))
        bits = np.packbits(above[1:] >= row[:-1], bitorder="little")
        up[i, : len(bits)] = bits
        above = row
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif up[i, (j - 1) >> 3] >> ((j - 1) & 7) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


#: Characters of the shorter text up to which pairs of texts are compared many at a time, and how many.
TOGETHER_CHARS, TOGETHER = 4096, 512


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Levenshtein distances in characters. A column of each pair's table is held as bits, whether a cell is
    one above or one below the cell before it; texts of like lengths take their steps together."""
    out, wait = [0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a or a == b:
            out[k] = 0 if a == b else len(b)
        elif len(a) > TOGETHER_CHARS:
            out[k] = _distance(a, b)
        else:
            wait.append((-(-len(a) // 64), len(b), k, a, b))
    wait.sort(key=lambda x: (-x[0], -x[1]))
    for i in range(0, len(wait), TOGETHER):
        some = sorted(wait[i : i + TOGETHER], key=lambda x: -x[1])  # those still in work come first
        for (*_, k, _, _), d in zip(some, _distances([x[3:] for x in some])):
            out[k] = int(d)
    return out


def _distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Of pairs by falling length of the second text, the first not empty."""
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    n_words = -(-int(sizes[:, 0].max()) // 64)
    tables, rows, base = [np.zeros((1, n_words), np.uint64)], np.zeros((int(sizes[0, 1]), len(pairs)), np.int64), 1
    for k, (a, b) in enumerate(pairs):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
        chars, code = np.unique(x, return_inverse=True)
        bits = np.zeros((len(chars), n_words * 64), np.uint8)
        bits[code, np.arange(len(x))] = 1
        tables.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
        at = np.minimum(np.searchsorted(chars, y), len(chars) - 1)
        rows[: len(y), k] = np.where(chars[at] == y, at + base, 0)  # row 0: a character that is not there
        base += len(chars)
    places = np.ascontiguousarray(np.concatenate(tables).T)
    more = np.full((n_words, len(pairs)), np.iinfo(np.uint64).max, np.uint64)
    less = np.zeros_like(more)
    one, last = np.uint64(1), np.uint64(63)
    active = np.searchsorted(-sizes[:, 1], -np.arange(int(sizes[0, 1])), side="left").tolist()  # longer than the step
    for row, n in zip(rows, active):
        row = row[:n]
        up, down = np.ones(n, np.uint64), np.zeros(n, np.uint64)  # the first row rises by one a step
        for w in range(n_words):
            same, p, m = places[w][row], more[w, :n], less[w, :n]
            vertical = same | m
            same |= down
            level = ((same & p) + p ^ p) | same
            right, left = m | ~(level | p), p & level
            next_up, next_down = right >> last, left >> last
            right, left = right << one | up, left << one | down
            more[w, :n], less[w, :n] = left | ~(vertical | right), right & vertical
            up, down = next_up, next_down
    # the column's end: its start, the length of the second text, and all steps down to the first one's length
    word = np.arange(n_words)[:, None]
    own = np.clip(sizes[:, 0][None] - 64 * word, 0, 64).astype(np.uint64)
    mask = np.where(own == 64, np.iinfo(np.uint64).max, (one << np.minimum(own, last)) - one)
    return sizes[:, 1] + np.bitwise_count(more & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(less & mask).sum(axis=0, dtype=np.int64)


def _distance(a: str, b: str) -> int:
    """Of one pair, the bits as whole numbers of any length."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    more, less = full, 0
    for y in b:
        same = at.get(y, 0)
        level = ((same & more) + more ^ more) | same
        right = (less | full & ~(level | more)) << 1 & full | 1
        left, vertical = (more & level) << 1 & full, same | less
        more, less = left | full & ~(vertical | right), right & vertical
    return len(b) + more.bit_count() - less.bit_count()


def common_runs(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of common contiguous runs, longest first, none inside one already taken."""
    found = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                k = 1
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if k >= least:
                    found.append((i, j, k))
    found.sort(key=lambda x: (-x[2], x[0], x[1]))
    kept: list[tuple[int, int, int]] = []
    for i, j, k in found:
        if not any((x <= i and i + k <= x + z) or (y <= j and j + k <= y + z) for x, y, z in kept):
            kept.append((i, j, k))
    return kept


def canonical(word: str) -> str:
    return re.sub(r"[.,-]", "", word) if len(word) > 1 else word


def stem(word: str) -> str:
    """A light suffix stripper; a stand-in for a full stemmer."""
    for end in ("ational", "iveness", "fulness", "ization", "ations", "ation", "ingly", "ments", "ment", "ness", "ings", "ing", "edly", "ies", "ed", "ly", "es", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def relatedness(a: str, b: str, synonyms: frozenset[tuple[str, str]] = frozenset()) -> float:
    """1 for the same word or stem, 0.9 for synonyms, else 0."""
    x, y = canonical(a.lower()), canonical(b.lower())
    if x == y:
        return 1.0
    if x.isdigit() or y.isdigit() or (x in STOP) != (y in STOP) or x in PUNCTUATION or y in PUNCTUATION:
        return 0.0
    if stem(x) == stem(y):
        return 1.0
    return 0.9 if (min(x, y), max(x, y)) in synonyms else 0.0


def align_words(a: list[str], b: list[str], synonyms: frozenset[tuple[str, str]] = frozenset(), window: int = 3) -> list[tuple[int, int]]:
    """Monolingual alignment without a parser, 0-based: final punctuation, identical runs of two
    words or more, then content words by 0.9 similarity + 0.1 neighbourhood evidence (first in
    index order on ties), then stop words whose neighbours are aligned."""
    left, right, out = set(range(len(a))), set(range(len(b))), []

    def take(i: int, j: int) -> None:
        left.discard(i)
        right.discard(j)
        out.append((i, j))

    if a and b and a[-1] in ".!?" and b[-1] in ".!?":
        take(len(a) - 1, len(b) - 1)
    for i, j, k in common_runs([w.lower() for w in a], [w.lower() for w in b]):
        if all(w.lower() in STOP or w in PUNCTUATION for w in a[i : i + k]):
            continue
        for d in range(k):
            if i + d in left and j + d in right:
                take(i + d, j + d)

    def evidence(i: int, j: int) -> float:
        done = set(out)
        near = [(i + d, j + e) for d in range(-window, window + 1) for e in range(-window, window + 1) if d and e]
        return sum(1.0 for p, q in near if 0 <= p < len(a) and 0 <= q < len(b) and a[p].lower() not in STOP and ((p, q) in done or relatedness(a[p], b[q], synonyms) >= 0.9))

    content = lambda w: w.lower() not in STOP and w not in PUNCTUATION
    pairs = [(i, j, relatedness(a[i], b[j], synonyms)) for i in sorted(left) for j in sorted(right) if content(a[i]) and content(b[j])]
    pairs = [p for p in pairs if p[2] >= 0.9]
    while pairs:
        best = max(pairs, key=lambda p: (0.9 * p[2] + 0.1 * evidence(p[0], p[1]), -p[0], -p[1]))
        take(best[0], best[1])
        pairs = [p for p in pairs if p[0] != best[0] and p[1] != best[1]]
    for i in sorted(left):
        for j in sorted(right):
            if a[i].lower() == b[j].lower() and {(i - 1, j - 1), (i + 1, j + 1)} & set(out):
                take(i, j)
                break
    return sorted(out)


def edit_labels(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Labels of source words (D deleted, R replaced, M moved, C copied) and target words (A added,
    R, M, C). An unaligned source word between the same aligned neighbours as an unaligned target
    word is replaced; an aligned word off the longest increasing chain is moved."""
    src, tgt = ["D"] * len(a), ["A"] * len(b)
    pairs = sorted(pairs)
    chain = set(_increasing(pairs))
    for k, (i, j) in enumerate(pairs):
        label = "M" if k not in chain else ("C" if a[i].lower() == b[j].lower() else "R")
        src[i] = tgt[j] = label
    ends = [(-1, -1), *(pairs[k] for k in sorted(chain)), (len(a), len(b))]
    for (i0, j0), (i1, j1) in zip(ends, ends[1:]):
        gone = [i for i in range(i0 + 1, i1) if src[i] == "D"]
        new = [j for j in range(j0 + 1, j1) if tgt[j] == "A"]
        for i, j in zip(gone, new):
            src[i] = tgt[j] = "R"
    return src, tgt


def _increasing(pairs: list[tuple[int, int]]) -> list[int]:
    """Positions of a longest chain with increasing targets."""
    # of equally long chains the one whose ends come first: lowest[r] has the chains of length r + 1 by
    # falling target, so the earliest end below a target is found by bisection
    ends: list[list[int]] = []  # places of ends of length r + 1, in order; targets fall along them
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        r = bisect_left(ends, True, key=lambda of: pairs[of[-1]][1] >= j)
        if r:
            of = ends[r - 1]
            before.append(of[bisect_left(of, True, key=lambda p: pairs[p][1] < j)])
        else:
            before.append(-1)
        if r == len(ends):
            ends.append([])
        ends[r].append(k)
    out, k = [], ends[-1][0] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def sentence_groups(pairs: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Sentence pairs in given order to groups: one-to-one, one-to-many, many-to-one. A pair that
    would make a many-to-many group becomes a group of its own."""
    groups: list[tuple[list[int], list[int]]] = []
    of_a: dict[int, int] = {}
    of_b: dict[int, int] = {}
    for i, j in pairs:
        if i in of_a and j not in of_b and len(groups[of_a[i]][0]) == 1:
            g = of_a[i]
            groups[g][1].append(j)
        elif j in of_b and i not in of_a and len(groups[of_b[j]][1]) == 1:
            g = of_b[j]
            groups[g][0].append(i)
        else:
            g = len(groups)
            groups.append(([i], [j]))
        of_a[i] = of_b[j] = g
    return groups


def samsa_score(scenes: list[dict], n_sentences: int) -> float:
    """Score in [0, 1] of one text given its scenes: dicts of the sentence a scene matches, and whether
    its relation's and each participant's minimal centre appears there (None: it has no centre, half a
    point; so does a scene without participants)."""
    point = lambda x: 0.5 if x is None else float(bool(x))
    n = len(scenes)
    if not n or n < n_sentences:
        return 0.0
    total = 0.0
    for s in scenes:
        people = s["participants"]
        total += 0.5 * point(s["relation"]) + 0.5 * (sum(map(point, people)) / len(people) if people else 0.5)
    return n_sentences / n**2 * total


def match_scenes(lengths: list[list[int]]) -> list[int]:
    """Sentence of each scene: greedily the longest alignment first; a sentence is used again only if
    there are more scenes than sentences."""
    n, m = len(lengths), len(lengths[0]) if lengths else 0
    out, free = [-1] * n, set(range(m))
    for s, t in sorted(((i, j) for i in range(n) for j in range(m)), key=lambda p: (-lengths[p[0]][p[1]], p)):
        if out[s] < 0 and (t in free or n > m):
            out[s] = t
            free.discard(t)
    return out


def minimal_centres(edges: dict[str, list[tuple[str, str]]], node: str) -> list[str]:
    """Leaves reached from a node by process, state and centre edges; the node itself if it has none."""
    heads = [child for tag, child in edges.get(node, []) if tag in ("P", "S", "C")]
    if not heads:
        return [node] if not edges.get(node) else []
    return [leaf for h in heads for leaf in minimal_centres(edges, h)]


@F.pandas_udf(Ty.IntegerType())
def levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """As Spark's levenshtein, for texts of hundreds of characters, at a fraction of its time."""
    whole = (a.notna() & b.notna()).to_numpy()
    found = iter(edit_distances(list(zip(a[whole], b[whole]))))
    return pd.Series([next(found) if x else None for x in whole], dtype="Int32")


@F.pandas_udf(Ty.IntegerType())
def shared_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens that two arrays have in common, repeats counted."""
    return pd.Series([(Counter(x) & Counter(y)).total() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(PAIRS)
def lcs_alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    """0-based index pairs of the longest common subsequence of two word arrays."""
    return pd.Series([[{"a": i, "b": j} for i, j in lcs_pairs(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b)])


@F.pandas_udf(WORDS)
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[x[i] for i, _ in lcs_pairs(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b)])


@F.pandas_udf(PAIRS)
def word_alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    """1-based pairs of aligned words, without a parser."""
    return pd.Series([[{"a": i + 1, "b": j + 1} for i, j in align_words(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b)])


@F.pandas_udf(LABELLED)
def edit_operations(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Edit labels of two word arrays, aligned by their longest common subsequence."""
    for a, b in it:
        rows = [edit_labels(list(x), list(y), lcs_pairs(list(x), list(y))) for x, y in zip(a, b)]
        yield pd.DataFrame({"source": [r[0] for r in rows], "target": [r[1] for r in rows]})


def outside_lcs(words: list[str], other: list[str]) -> str:
    """Words with those outside the longest common subsequence in bold."""
    inside = {i for i, _ in lcs_pairs(words, other)}
    return " ".join(w if i in inside else f"<b>{w}</b>" for i, w in enumerate(words))
