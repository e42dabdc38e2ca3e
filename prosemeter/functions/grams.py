"""Gram counts of samples, summed up a row: an Arrow-batched UDF over whole texts. Rows are taken some at a
time, so memory follows the longest row; all counts are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prosemeter.functions.text import ENTITIES, LESS, MORE, SYLLABLES

ORDER = 4
SUMS = ("add_correct", "add_sys", "add_ref", "keep_correct", "keep_sys", "keep_ref", "del_correct", "del_sys", "del_ref")
#: Bytes of text worked on at a time, and neighbouring rows of one source whose grams are numbered together.
BYTES, TOGETHER = 1 << 22, 4

SPACE, ALONE, STOP, DIGIT, DASH = range(1, 6)


def _kinds(cuts: bool) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[*(b" \t\n\r\f\x0b" if cuts else b" ")]] = SPACE
    if cuts:
        out[[*b'{|}~[\\]^_`!"#$%&()*+:;<=>?@/']] = ALONE
        out[[*b".,"]], out[[*b"0123456789"]], out[[*b"-"]] = STOP, DIGIT, DASH
    return out


KINDS = {cuts: _kinds(cuts) for cuts in (False, True)}


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts (and the last ends), and all bytes."""
    texts = texts.cast(pa.string())
    _, offsets, body = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def tokens(texts: pa.Array, cuts: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all tokens, where the tokens of each text start (and the last end), and the token of each code.

    cuts: the tokens of `text.normalize` with 13a, case kept; else what stands between spaces. The regular
    expressions of 13a only put spaces in, so a byte starts a token or does not.
    """
    for a, b in (("<skipped>", ""), ("-\n", ""), *ENTITIES) if cuts else ():
        if pc.any(pc.match_substring(texts, a)).as_py():
            texts = pc.replace_substring(texts, a, b)
    at, data = _bytes(texts)
    some = at[1:] > at[:-1]
    kind = KINDS[cuts][data]
    if cuts:
        wide = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))  # U+00A0
        kind[wide] = kind[wide + 1] = SPACE
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[at[:-1][some]] = SPACE
    first = before == SPACE
    if cuts:
        alone = (kind == ALONE) | (kind == DASH) & (before == DIGIT)
        stops = np.flatnonzero(kind == STOP)
        if len(stops):
            after = np.empty_like(kind)
            after[:-1] = kind[1:]
            after[at[1:][some] - 1] = SPACE
            starts = np.flatnonzero(before[stops] != STOP)
            ends = np.append(starts[1:], len(stops))
            # a run's stops are taken two by two, the first with what is before it unless that is a digit; one that
            # is left over stays with a digit after it
            odd, digit = (ends - starts) % 2 == 1, before[stops[starts]] == DIGIT
            alone[stops] = True
            alone[stops[ends - 1][(odd == digit) & (after[stops[ends - 1]] == DIGIT)]] = False
        first |= alone
        first[1:] |= alone[:-1]
    kept = kind != SPACE
    first &= kept
    places = np.append(np.flatnonzero(first[kept]), kept.sum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data[kept])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), np.append(0, np.cumsum(first))[at], words.dictionary


#: What every match of a pattern that is none itself holds: the pattern is rarely run.
_SURE = {"[aeiouy]bl$": "bl$", "[^l]llien": "llien", "^coad.": "^coad", "^coag.": "^coag", "^coal.": "^coal", "^coax.": "^coax", ".ely$": "ely$", MORE[11]: "l$", MORE[17]: "ua"}


def _found(stems: pa.Array, pattern: str) -> np.ndarray:
    """Whether the pattern is in each stem, by plain string tests where they do."""
    body = _SURE.get(pattern, pattern).strip("^$")
    if not body.isalpha():
        return pc.match_substring_regex(stems, pattern).to_numpy(zero_copy_only=False)
    test = pc.starts_with if pattern[0] == "^" else pc.ends_with if pattern[-1] == "$" else pc.match_substring
    out = test(stems, body).to_numpy(zero_copy_only=False)
    if pattern in _SURE and out.any():
        out = out.copy()
        out[out] = pc.match_substring_regex(stems.filter(pa.array(out)), pattern).to_numpy(zero_copy_only=False)
    return out


def syllables(words: pa.Array) -> np.ndarray:
    """As text.syllables, of lower-case tokens."""
    stems = pc.utf8_rtrim(words, "e")
    at, data = _bytes(stems)
    vowel = np.isin(data, [*b"aeiouy"])
    again = np.append(False, vowel[:-1])[: len(data)]
    again[at[:-1][at[1:] > at[:-1]]] = False
    vowel &= ~again  # the first of a run
    out = np.diff(np.append(0, np.cumsum(vowel))[at])
    for sign, patterns in ((1, MORE), (-1, LESS)):
        for p in patterns:
            out += sign * _found(stems, p)
    known = pc.index_in(words, pa.array(list(SYLLABLES))).fill_null(-1).to_numpy()
    return np.where(known >= 0, np.array(list(SYLLABLES.values()))[known], out)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them."""
    bits = int(len(key)).bit_length()
    if int(key.max()).bit_length() + bits < 63:  # sorted with their places in the low bits: no indirect sort
        both = np.sort(key << bits | np.arange(len(key)))
        order, by = both & (1 << bits) - 1, both >> bits
    else:
        order = np.argsort(key, kind="stable")
        by = key[order]
    new = np.append(True, by[1:] != by[:-1])
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return by[new], place


def _row_sums(orig: pa.Array, sys: pa.Array, refs: pa.Array, cuts: bool, whole: bool) -> dict[str, np.ndarray]:
    n = len(orig)
    rows = np.arange(n)
    k = refs.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    absent = refs.is_null().to_numpy(zero_copy_only=False)
    pool = pa.concat_arrays([orig, sys, refs.flatten()]).fill_null("").dictionary_encode()
    which, n_texts = pool.indices.to_numpy().astype(np.int64), len(pool.dictionary)
    code, starts, words = tokens(pool.dictionary, cuts)
    size = np.diff(starts)
    o, s, r = which[:n], which[n : 2 * n], which[2 * n :]
    ref_row = np.repeat(rows, k)
    ref_id = np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k)

    # neighbouring rows of one source are a group, whose distinct texts are its sides
    slot = (rows - np.maximum.accumulate(np.where(np.append(True, o[1:] != o[:-1]), rows, 0))) % TOGETHER
    group = np.cumsum(slot == 0) - 1
    n_groups, n_slots, n_refs = int(group[-1]) + 1, int(slot.max()) + 1, int(k.max())
    pairs, seen, back = np.unique(np.concatenate([group * n_texts + o, group * n_texts + s, group[ref_row] * n_texts + r]), return_index=True, return_inverse=True)
    owner, text = np.divmod(pairs, n_texts)
    side = np.empty(len(pairs), np.int64)
    side[np.lexsort((seen, owner))] = np.arange(len(pairs)) - np.searchsorted(owner, owner)
    none = int(side.max()) + 1  # the side of a row or a reference that is not there
    place = side[back]
    at_o, at_s, at_r, of_k = np.zeros(n_groups, np.int64), np.full((n_slots, n_groups), none), np.full((n_slots, n_refs, n_groups), none), np.zeros((n_slots, n_groups), np.int64)
    at_o[group] = place[:n]
    at_s[slot, group], of_k[slot, group] = place[n : 2 * n], k
    at_r[slot[ref_row], ref_id, group[ref_row]] = place[2 * n :]
    for j in range(1, n_slots):  # rows that are not there repeat the references before them, whose counts serve again
        gone = at_s[j] == none
        at_r[j][:, gone], of_k[j, gone] = at_r[j - 1][:, gone], of_k[j - 1, gone]

    length = size[text]
    ends = np.cumsum(length)
    n_tokens = int(ends[-1])
    token = code[np.repeat(starts[text] - ends + length, length) + np.arange(n_tokens)]
    left = np.repeat(ends, length) - np.arange(n_tokens)
    column = np.repeat(side, length)
    out: dict[str, np.ndarray] = {"grams": np.where(absent, 0, size[o] + size[s] + np.bincount(ref_row, weights=size[r], minlength=n).astype(np.int64))}
    scores = np.full((n_refs, n), np.nan)
    at, gram, above, n_words = np.arange(n_tokens), np.zeros(n_tokens, np.int64), np.zeros(0, np.int64), max(len(words), 1)
    for m in range(1, ORDER + 1):
        at = at[left[at] >= m]
        found = {c: np.zeros(n, np.int64) for c in ("both", "add_sys", "add_ref", "kept", "keep_ref", "keep_correct", "clipped")}
        if len(at):
            key = (gram[at] if m > 1 else np.repeat(owner, length)) * n_words + token[at + m - 1]
            grams, number = _ranked(key)
            above = grams // n_words if m == 1 else above[grams // n_words]  # the group of each gram, in order
            gram[at] = number
            total = len(grams)
            counts = np.bincount(column[at] * total + number, minlength=(none + 1) * total)
            bounds = np.searchsorted(above, np.arange(n_groups + 1))
            every = np.arange(total)

            def side_counts(of: np.ndarray) -> np.ndarray:
                one = int(of[0])
                return counts[one * total : (one + 1) * total] if (of == one).all() else counts[of[above] * total + every]

            def summed(x: np.ndarray) -> np.ndarray:
                return np.diff(np.append(0, np.cumsum(x))[bounds])

            source = side_counts(at_o)
            fresh = source == 0
            for j in range(n_slots):
                own = np.flatnonzero(slot == j)
                by = group[own]
                if not j or (at_r[j] != at_r[j - 1]).any() or (of_k[j] != of_k[j - 1]).any():
                    each = [side_counts(x) for x in at_r[j]]
                    r_sum = sum(each[1:], each[0]) if each else np.zeros(total, np.int64)
                    times, in_ref = of_k[j][above], r_sum > 0
                    most = (each[0] if len(each) == 1 else np.maximum.reduce(each)) if whole and each else r_sum
                    keep_ref, add_ref = summed(np.minimum(source * times, r_sum)), summed(fresh & in_ref)
                mine = side_counts(at_s[j])
                new, same = fresh & (mine > 0), np.minimum(source, mine)
                found["keep_ref"][own], found["add_ref"][own] = keep_ref[by], add_ref[by]
                found["add_sys"][own], found["both"][own] = summed(new)[by], summed(new & in_ref)[by]
                found["kept"][own], found["keep_correct"][own] = summed(same)[by], summed(np.minimum(same * times, r_sum))[by]
                if whole:
                    found["clipped"][own] = summed(np.minimum(mine, most))[by]
                    for q in range(n_refs if m == 1 else 0):
                        scores[q, own] = summed(np.minimum(mine, each[q]))[by]
        # what is deleted is what the source has and is not kept, in all counts
        had, keep_sys = k * np.maximum(size[o] - m + 1, 0), k * found["kept"]
        sums = (found["both"], found["add_sys"], found["add_ref"], found["keep_correct"], keep_sys, found["keep_ref"],
                had - keep_sys - found["keep_ref"] + found["keep_correct"], had - keep_sys, had - found["keep_ref"])
        out |= {f"{c}{m}": x for c, x in zip(SUMS, sums)}
        if whole:
            out |= {f"c{m}": found["clipped"], f"t{m}": np.where(absent, 0, np.maximum(size[s] - m + 1, 0))}
    if not whole:
        return out

    far = np.iinfo(np.int64).max
    known = np.bincount(ref_row, weights=refs.flatten().is_null().to_numpy(zero_copy_only=False), minlength=n) == 0
    lengths = np.zeros((n_refs, n), np.int64)
    there = np.zeros((n_refs, n), bool)
    lengths[ref_id, ref_row], there[ref_id, ref_row] = size[r], True
    closest = np.where(there, np.abs(lengths - size[s]) << 32 | lengths, far).min(axis=0, initial=far)
    out |= {"sys_len": size[s], "ref_len": np.where((k > 0) & known, closest & (1 << 32) - 1, 0)}
    correct = np.where(there, np.nan_to_num(scores), 0)
    p, q = correct / np.maximum(size[s], 1), correct / np.maximum(lengths, 1)
    with np.errstate(invalid="ignore"):
        f1 = np.where((p > 0) & (q > 0), 2 * p * q / (p + q), 0.0)
    out["f1"] = np.where(k > 0, f1.max(axis=0, initial=0.0), np.nan)
    spoken = np.append(0, np.cumsum(syllables(words)[code]))[starts]
    marks = pc.is_in(words, pa.array([".", "!", "?"])).to_numpy(zero_copy_only=False).astype(np.int64)[code]
    inner = np.diff(np.append(0, np.cumsum(marks))[starts])
    inner[size > 0] -= marks[starts[1:][size > 0] - 1]
    return out | {"n_sentences": np.where(size > 0, 1 + inner, 0)[s], "n_syllables": np.diff(spoken)[s]}


def fields(whole: bool) -> list[str]:
    out = ["grams", *(f"{c}{m}" for c in SUMS for m in range(1, ORDER + 1))]
    return out + [*(f"{c}{m}" for c in "ct" for m in range(1, ORDER + 1)), "sys_len", "ref_len", "f1", "n_sentences", "n_syllables"] if whole else out


def sample_sums(cuts: bool, whole: bool):
    """A UDF of (source, output, references), strings of which
    13a tokens are cut here or that have spaces between tokens: tokens of all texts (`grams`) and, of each order, the nine
    sums of SARI. whole: also BLEU's matches c and totals t, lengths, token F1 (null without references), and
    sentences and syllables of the output. Null texts are empty (with one among them, the
    references have no length); without an array of references there are no grams."""
    names = fields(whole)
    kinds = {c: Ty.DoubleType() if c == "f1" else Ty.LongType() for c in names}

    @F.arrow_udf(Ty.StructType([Ty.StructField(c, t) for c, t in kinds.items()]))
    def sums(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for orig, sys, refs in batches:
            yield batch_sums(orig, sys, refs, cuts, whole)

    return sums


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)


def batch_sums(orig: pa.Array, sys: pa.Array, refs: pa.Array, cuts: bool, whole: bool) -> pa.StructArray:
    names, parts = fields(whole), []
    if len(orig):
        of_refs = np.append(0, np.cumsum(_sizes(refs.flatten())))[np.append(0, np.cumsum(refs.value_lengths().fill_null(0).to_numpy()))]
        ends, total = np.cumsum(_sizes(orig) + _sizes(sys) + np.diff(of_refs)), 0
        i = 0
        while i < len(orig):
            j = max(i + 1, int(np.searchsorted(ends, total + BYTES, side="right")))
            parts.append(_row_sums(orig.slice(i, j - i), sys.slice(i, j - i), refs.slice(i, j - i), cuts, whole))
            i, total = j, int(ends[j - 1])
    arrays = []
    for c in names:
        x = np.concatenate([p[c] for p in parts]) if parts else np.zeros(0)
        arrays.append(pa.array(x, pa.float64(), from_pandas=True) if c == "f1" else pa.array(x.astype(np.int64), pa.int64()))
    return pa.StructArray.from_arrays(arrays, names)
