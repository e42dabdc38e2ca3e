"""DuckDB spellings of the text functions, for the oracle."""

from __future__ import annotations

from prosemeter.functions import text as T

WS = r"[ \t\n\r\f\v\x{A0}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def normalize(x: str, lowercase: bool = True, tokenizer: str = "13a") -> str:
    x = f"lower({x})" if lowercase else x
    if tokenizer == "none":
        return squeeze(x)
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in T.ENTITIES:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    x = f"(' ' || {x} || ' ')"
    for pattern, to in T.SPLITS_13A:
        x = sub(x, pattern, to.replace("$", "\\"))
    return squeeze(x)


def split_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda z: z <> '')"


def words(x: str, lowercase: bool = True, tokenizer: str = "13a") -> str:
    return split_words(normalize(x, lowercase, tokenizer))


def syllables(w: str) -> str:
    """Of a word already in lower case without outer spaces."""
    stem = f"rtrim({w}, 'e')"
    rules = " + ".join(f"CAST(regexp_matches({stem}, {quoted(p)}) AS INT)" for p in T.MORE) + "".join(f" - CAST(regexp_matches({stem}, {quoted(p)}) AS INT)" for p in T.LESS)
    known = "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in T.SYLLABLES.items()) + "}"
    return f"coalesce({known}[{w}], len(regexp_extract_all({stem}, '[aeiouy]+')) + {rules})"


def stop_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?]+'), lambda z: {strip('z')}), lambda z: z <> '')"


def pieces_text(x: str) -> str:
    return sub(strip(x), f"{WS}*[.!?]+{WS}*", "  ")


def boundary_sentences(ws: str) -> str:
    return f"CASE WHEN len({ws}) > 0 THEN 1 + len(list_filter({ws}[1:len({ws}) - 1], lambda z: z IN ('.', '!', '?'))) ELSE 0 END"
