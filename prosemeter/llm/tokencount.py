"""Exact BPE token counts by prefix dynamic programming.

For one pre-token w the table last[i] holds the only vocabulary token that can end
the encoding of w[:i]: the token t = w[j:i] whose pair with last[j] the merge rules
leave standing. count[i] = count[j] + 1 follows, so one left-to-right pass gives the
exact count of every prefix, and truncation and budget questions need no encoding of
their own. Counts of a text are running sums over its pre-tokens.

Letters, numbers and white space are those of the library's Unicode version, asked of its
regular expressions once a worker; its normalizer composes and lowers texts beyond ASCII. A vocabulary file whose normalizer, pre-tokenizer or
model is another than the one implemented is refused.

Null texts count as empty (0 tokens). Special strings inside a text are one token
each, as the library has it by default. Lone surrogates cannot occur: Spark strings
are UTF-8. Rows repeat as often as in the input; further columns pass through
`token_counts` untouched; one of an output's name is replaced. An empty table gives an
empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers
from tokenizers.pre_tokenizers import Split

from prosemeter.llm.common import n_bytes

#: The normalizer and pre-tokenizer that are implemented here, as a vocabulary file writes them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Model settings that are implemented; any end_of_word_suffix is.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: str.split() parts at these too, the pattern does not.
NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")
#: Chunks, words and token pairs that a worker keeps; a table is emptied when full.
KEPT_CHUNKS = 800_000
KEPT_WORDS = 500_000
KEPT_PAIRS = 1_000_000
#: Chunks and words beyond this many characters are counted and not kept.
LONG = 64


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"


def ranges(inside: np.ndarray, every: str) -> str:
    """A character class of the marked code points."""
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    point = lambda i: f"\\U{ord(every[i]):08x}"
    return "".join(f"{point(a)}-{point(b)}" for a, b in zip(np.flatnonzero(step > 0).tolist(), (np.flatnonzero(step < 0) - 1).tolist()))


@lru_cache(maxsize=1)
def pre_tokens() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The pre-tokenizer's pattern by properties, the code points whose properties the library's
    own regular expressions see otherwise (another Unicode version), and the pattern for texts that
    hold some, with the library's classes written out."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    theirs, odd = {}, np.zeros(len(every), dtype=bool)
    for name, own, library in (("L", r"\p{L}", r"\p{L}"), ("N", r"\p{N}", r"\p{N}"), ("S", r"\p{White_Space}", r"\s")):
        inside = np.ones(len(every), dtype=bool)
        for _, (a, b) in Split(Regex(library), "removed").pre_tokenize_str(every):
            inside[a:b] = False
        here = np.zeros(len(every), dtype=bool)
        for m in regex.finditer(f"{own}+", every):
            here[m.start() : m.end()] = True
        odd |= here != inside
        theirs[name] = ranges(inside, every)
    plain = PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=r"\p{White_Space}")
    return regex.compile(plain), regex.compile(f"[{ranges(odd, every)}]" if odd.any() else "(?!)"), regex.compile(PATTERN.format(**theirs))


def byte_alphabet() -> list[str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stands for
    itself, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class PrefixCounter(dict):
    """Chunk between white space -> token count, filled on demand.

    No pre-token crosses white space, so a chunk's count is that of its pre-tokens.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or any(model.get(k, v) != v for k, v in MODEL.items()):
            raise ValueError(f"{path}: its normalizer, pre-tokenizer or model is not one that is counted here")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with flags are not counted here")
        self.plain, self.odd, self.exact = pre_tokens()
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Of every vocabulary entry that its own characters merge into: the rank of the last merge, and its halves.
        self.last: dict[str, tuple[int, str, str]] = {}
        for token in model["vocab"]:
            self.learn(token)
        self.of_word: dict[str, int] = {}
        self.longest = max(map(len, self.last))
        #: Finds every entry without an end mark that ends at a byte, the longest first.
        self.inside = ahocorasick.Automaton()
        for token in self.last:
            if not (self.end and token.endswith(self.end)):
                self.inside.add_word(token, token)
        self.inside.make_automaton()

    def learn(self, token: str) -> None:
        symbols = self.symbols(token)
        if len(symbols) == 1:
            self.last[token] = (-1, token, token)
            return
        halves = self.merged(symbols, 2)
        if len(halves) == 2 and tuple(halves) in self.rank:
            self.last[token] = (self.rank[tuple(halves)], halves[0], halves[1])

    def merged(self, symbols: list[str], down_to: int = 1) -> list[str]:
        """The symbols after merging, lowest rank first, leftmost first, to no fewer than `down_to`."""
        while len(symbols) > down_to:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            a, out, i = ranks.index(best), [], 0
            left, right = symbols[a], symbols[a + 1]
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def joins(self, left: str, right: str) -> bool:
        """The merge rules leave the boundary between two tokens standing.

        Undoes the later of the two tokens' last merges step by step; a merge across
        the boundary that would have come before the one undone breaks it. Of equal
        ranks the left one comes first.
        """
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.undo(left, right)
        return got

    def undo(self, left: str, right: str) -> bool:
        rank, last = self.rank, self.last
        before = 1 << 60
        while True:
            if rank.get((left, right), 1 << 60) < before:
                return False
            (a, _, left_end), (b, right_start, _) = last[left], last[right]
            if a > b:
                before, left = a, left_end
            elif b >= 0:
                before, right = b + 1, right_start
            else:
                return True

    def prefixes(self, word: str, only_whole: bool = False) -> list[int]:
        """count[i]: tokens of the first i bytes of the word, taken as a word.

        only_whole: fill no entry of it but the last; the running table is the same.
        """
        chars = "".join(map(self.alphabet.__getitem__, word.encode()))
        n, end, known, joins = len(chars), self.end, self.last, self.joins
        ends: list[str] = [""] * (n + 1)
        inner = [0] * (n + 1)
        for at, piece in self.inside.iter(chars):
            i = at + 1
            if not ends[i]:
                j = i - len(piece)
                if not j or joins(ends[j], piece):
                    ends[i], inner[i] = piece, inner[j] + 1
        closed = [0] * (n + 1)
        for i in [n] if only_whole else range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                final = chars[j:i] + end
                if final in known and (not j or joins(ends[j], final)):
                    closed[i] = inner[j] + 1
                    break
        return closed

    def word(self, word: str) -> int:
        n = self.of_word.get(word)
        if n is None:
            n = self.prefixes(word, True)[-1]
            if len(word) <= LONG:
                if len(self.of_word) >= KEPT_WORDS:
                    self.of_word.clear()
                self.of_word[word] = n
        return n

    def __missing__(self, chunk: str) -> int:
        n = sum(1 if w is None else self.word(w) for w in self.words(chunk))
        if len(chunk) <= LONG:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = n
        return n

    def normal(self, text: str) -> str:
        """Beyond ASCII by the library's own normalizer, whose Unicode version may be another than Python's."""
        return text.lower() if text.isascii() else self.library.normalize_str(text)

    def find(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or not self.odd.search(text) else self.exact).findall(text)

    def words(self, text: str) -> list[str | None]:
        """Pre-tokens of a text; None stands for a special string."""
        if self.split is None or not any(s in text for s in self.specials):
            return self.find(self.normal(text))
        out: list[str | None] = []
        for k, part in enumerate(self.split.split(text)):
            out += [None] if k % 2 else self.find(self.normal(part))
        return out

    def chunks(self, text: str) -> list[str]:
        return SPACE.split(text) if NOT_SPACE.search(text) else text.split()

    def running(self, text: str) -> np.ndarray:
        """Tokens up to the end of each chunk between white space: the prefix table of a text."""
        chunks = self.chunks(text)
        return np.cumsum(np.fromiter(map(self.__getitem__, chunks), dtype=np.int64, count=len(chunks)))

    def longest_prefix(self, text: str, budget: int) -> tuple[int, int, int]:
        """(chunks kept whole, pre-tokens kept of the next, bytes kept of the one after) of
        the longest prefix of at most `budget` tokens, read from the tables."""
        table = self.running(text)
        whole = int(np.searchsorted(table, budget, side="right"))
        if whole == len(table):
            return whole, 0, 0
        room = budget - (int(table[whole - 1]) if whole else 0)
        for k, word in enumerate(self.words(self.chunks(text)[whole])):
            n = 1 if word is None else self.word(word)
            if n > room:
                inside = [] if word is None else [i for i, c in enumerate(self.prefixes(word)) if c <= room]
                return whole, k, max(inside, default=0)
            room -= n
        return whole + 1, 0, 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit, and what a cut at `limit` tokens keeps:
    kept_chunks whole chunks between white space, kept_words pre-tokens of the next
    chunk and kept_bytes of the pre-token after.

    One narrow stage without a shuffle; each worker holds the vocabulary and
    the bounded tables above.
    """
    made = ["n_bytes", "n_tokens", "over_limit", "kept_chunks", "kept_words", "kept_bytes"]
    src = df.drop(*made).withColumn("n_bytes", n_bytes(F.col(text_col)))
    schema = src.withColumns({"n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False), "kept_chunks": F.lit(0).cast("long"), "kept_words": F.lit(0).cast("long"), "kept_bytes": F.lit(0).cast("long")}).schema
    for f in schema.fields:
        f.nullable = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(vocabulary)
        for batch in batches:
            n, kept = [], []
            for text in batch.column(text_col).to_pylist():
                table = tables.running(text or "")
                n.append(int(table[-1]) if len(table) else 0)
                kept.append((len(table), 0, 0) if n[-1] <= limit else tables.longest_prefix(text, limit))
            more = [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), *(pa.array([x[k] for x in kept], pa.int64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *made[1:]])

    return src.mapInArrow(count, schema)
