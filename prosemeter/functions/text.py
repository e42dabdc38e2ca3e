"""Tokens, sentences, syllables.

White space is ASCII white space and U+00A0, everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B\xA0]"

#: Syllables of words that the rules below get wrong (public readability scripts).
SYLLABLES = {
    "the": 1, "tottered": 2, "chummed": 1, "peeped": 1, "moustaches": 2, "shamefully": 3, "messieurs": 2, "satiated": 4,
    "sailmaker": 4, "sheered": 1, "disinterred": 3, "propitiatory": 6, "bepatched": 2, "particularized": 5, "caressed": 2,
    "trespassed": 2, "sepulchre": 3, "flapped": 1, "hemispheres": 3, "pencilled": 2, "motioned": 2, "poleman": 2,
    "slandered": 2, "sombre": 2, "etc": 4, "sidespring": 2, "mimes": 1, "effaces": 2, "mr": 2, "mrs": 2, "ms": 1, "dr": 2,
    "st": 1, "sr": 2, "jr": 2, "truckle": 2, "foamed": 1, "fringed": 2, "clattered": 2, "capered": 2, "mangroves": 2,
    "suavely": 2, "reclined": 2, "brutes": 1, "effaced": 2, "quivered": 2, "h'm": 1, "veriest": 3, "sententiously": 4,
    "deafened": 2, "manoeuvred": 3, "unstained": 2, "gaped": 1, "stammered": 2, "shivered": 2, "discoloured": 3,
    "gravesend": 2, "60": 2, "lb": 1, "unexpressed": 3, "greyish": 2, "unostentatious": 5,
}
#: Patterns that take a syllable away, and that add one (look-around written out).
LESS = ("cial", "tia", "cius", "cious", "gui", "ion", "iou", "sia$", ".ely$")
MORE = (
    "ia", "riet", "dien", "iu", "io", "ii", "[aeiouy]bl$", "mbl$", "[aeiou]{3}", "^mc", "ism$",
    "([^a]aa|[^e]ee|[^i]ii|[^o]oo|[^u]uu|[^y]yy)l$", "[^l]llien", "^coad.", "^coag.", "^coal.", "^coax.",
    "([^g]gua|[^q]qua)([^aeiou][aeiou]|a[eiou]|e[aiou]|i[aeou]|o[aeiu]|u[aeio])", "dnt$",
)
#: The four replacements of the 13a tokenizer (of the first, without the space, which would only
#: become more spaces).
SPLITS_13A = ((r"([{-~\[-`!-&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


#: The published international tokenizer splits punctuation but between numbers, and symbols.
SPLITS_INTL = ((r"(\P{N})(\p{P})", "$1 $2 "), (r"(\p{P})(\P{N})", " $1 $2"), (r"(\p{S})", " $1 "))


def normalize(c: Column, lowercase: bool = True, tokenizer: str = "13a") -> Column:
    """Tokens joined by single spaces; tokenizer 13a, intl or none."""
    c = F.lower(c) if lowercase else c
    if tokenizer == "none":
        return squeeze(c)
    if tokenizer == "intl":
        for pattern, to in SPLITS_INTL:
            c = F.regexp_replace(c, pattern, to)
        return squeeze(c)
    if tokenizer != "13a":
        raise ValueError(f"no tokenizer {tokenizer!r}; there are 13a, intl and none")
    c = _replace(_replace(_replace(c, "<skipped>", ""), "-\n", ""), "\n", " ")
    for a, b in ENTITIES:
        c = _replace(c, a, b)
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, to in SPLITS_13A:
        c = F.regexp_replace(c, pattern, to)
    return squeeze(c)


def split_words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def words(c: Column, lowercase: bool = True, tokenizer: str = "13a") -> Column:
    return split_words(normalize(c, lowercase, tokenizer))


def _matches(stem: Column, pattern: str) -> Column:
    """rlike, spelled with plain string tests where the pattern is a literal, an end or a start."""
    body = pattern.strip("^$")
    if body.isalpha():
        return stem.startswith(body) if pattern[0] == "^" else stem.endswith(body) if pattern[-1] == "$" else stem.contains(body)
    if pattern[0] == "^" and body[:-1].isalpha() and body[-1] == ".":
        return stem.startswith(body[:-1]) & (F.length(stem) >= len(body))
    if pattern[-1] == "$" and body[1:].isalpha() and body[0] == ".":
        return stem.endswith(body[1:]) & (F.length(stem) >= len(body))
    # what every match holds decides first: the pattern is rarely run
    sure = {"[aeiouy]bl$": stem.endswith("bl"), "[^l]llien": stem.contains("llien"), MORE[11]: stem.endswith("l"), MORE[17]: stem.contains("ua")}
    return sure[pattern] & stem.rlike(pattern) if pattern in sure else stem.rlike(pattern)


def rule_syllables(word: Column, stem: Column) -> Column:
    """Syllables given the lower-case word and its stem (without final e), each a column of its own:
    plain string tests that whole-stage code generation takes in."""
    known = F.create_map(*[F.lit(x) for item in SYLLABLES.items() for x in item])
    out = F.regexp_count(stem, F.lit("[aeiouy]+"))
    for p in MORE:
        out = out + F.when(_matches(stem, p), 1).otherwise(0)
    for p in LESS:
        out = out - F.when(_matches(stem, p), 1).otherwise(0)
    return F.when(word.isin(list(SYLLABLES)), F.try_element_at(known, word)).otherwise(out)


def stem_of(word: Column) -> Column:
    return F.rtrim(F.lower(F.trim(word)), F.lit("e"))


def syllables(word: Column) -> Column:
    """Syllables of one word; not floored at 1. For use inside lambdas: one-element arrays bind the
    word and its stem, which would be computed again at each mention."""
    return F.transform(F.array(F.lower(F.trim(word))), lambda w: F.transform(F.array(F.rtrim(w, F.lit("e"))), lambda s: rule_syllables(w, s))[0])[0]


def syllables_of(word_list: Column) -> Column:
    return F.aggregate(F.transform(word_list, syllables), F.lit(0).cast("long"), lambda a, x: a + x)


def stop_sentences(c: Column) -> Column:
    """Pieces between runs of . ! ?, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, "[.!?]+"), strip), lambda x: x != "")


def dot_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\."), strip), lambda x: x != "")


def lookbehind_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), rf"(?<=[.!?]){WS}+"), strip), lambda x: x != "")


def pieces_text(c: Column) -> Column:
    """The text with each run of . ! ? and the white space around it as two spaces."""
    return F.regexp_replace(strip(c), f"{WS}*[.!?]+{WS}*", "  ")


def boundary_sentences(word_list: Column) -> Column:
    """1 + the . ! ? tokens that are not the last token; 0 without tokens."""
    inner = F.slice(word_list, 1, F.greatest(F.size(word_list) - 1, F.lit(0)))
    return F.when(F.size(word_list) > 0, 1 + F.size(F.filter(inner, lambda x: x.isin(".", "!", "?")))).otherwise(0)


def plain_tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def alphabetic(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def canonical(word: Column) -> Column:
    """Drops . - , from words longer than one character."""
    return F.when(F.length(word) > 1, F.translate(word, ".-,", "")).otherwise(word)


def file_title(title: Column) -> Column:
    return F.translate(title, " /", "__")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = _replace(c, a, b)
    return c


def preview(c: Column, n: int = 200, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def is_acronym(short: Column, phrase: Column) -> Column:
    """The letters of `short` are the capitals that start the phrase's words."""
    heads = F.array_join(F.transform(F.split(squeeze(phrase), " "), lambda w: F.substring(w, 1, 1)), "")
    return F.translate(short, ".", "") == heads


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def fill_template(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def strip_fences(c: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(strip(c), rf"^```[A-Za-z0-9_-]*{WS}*|{WS}*```$", "")


#: Messages after which a request is made again.
RETRYABLE = r"(?i)(500|502|503|504|rate limit|timeout|connection)"
RETRYABLE_QA = r"(?i)(429|502|503|rate limit|timeout|timed out|connection|overloaded)"


def retryable(error: Column, pattern: str = RETRYABLE) -> Column:
    return F.coalesce(error.rlike(pattern), F.lit(False))
