"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prosemeter.llm import components, decontam, langid, licenses, mixing, registry, sharding, simhash, suffix_dedup, suffixsort, tokencount, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, weight int, k int"
ODD = [
    (1, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, "x", "y", 1, 1),
    (3, "   \n\t", "en", "a", 0, "x", "y", 1, 1),
    (4, "...!!! 123", "en", "a", 0, "x", "y", 1, 1),
    (5, "word", "en", "a", 4, "x", "y", 1, 1),
    (None, "text without an id, long enough to count as text " * 4, "en", "a", 4, "x", "y", 1, 1),
    (6, "the cat sat on the mat and the dog ran over the hill " * 4000, "en", "b", 9, "x", "y", 1, 1),
    (7, "same row twice, word for word, and long enough to be more than one hundred bytes so that windows of it count", "en", "b", 9, "x", "y", 1, 1),
    (7, "same row twice, word for word, and long enough to be more than one hundred bytes so that windows of it count", "en", "b", 9, "x", "y", 1, 1),
    (7, "same id, other text: the cat sat on the mat and the dog ran over the hill, again and again and again, on and on", "en", "b", 9, "x", "y", 1, 1),
    (8, "a" * 3000, "fr", "b", 9, "x", "y", 1, 1),
    (9, "日本語のテキスト " * 30 + "é\U0001f600", "ja", "b", 9, "x", "y", 1, 1),
    (10, "same row twice, word for word, and long enough to be more than one hundred bytes so that windows of it count", "en", "b", 9, "x", "y", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ 1


def test_language_accuracy(spark, data):
    got = registry.op1_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def _grams_brute(text):
    out = ["".join(c if c.isalpha() else " " for c in text.lower())]
    plain = " " + " ".join(out[0].split()) + " "
    return [plain[i : i + 3] for i in range(len(plain) - 2)]


def test_language_against_exact_sets(spark, data):
    """The filter's languages and scores against n-gram sets held exactly."""
    from collections import Counter

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    counts = {}
    for lang, text in {(r["lang"], r["text"]) for r in docs if not held(r["doc_id"]) and r["lang"] is not None and r["text"] is not None}:
        counts.setdefault(lang, Counter()).update(_grams_brute(text))
    rates = {c: {g: n / n_all.total() for g, n in n_all.items() if n >= langid.MIN_COUNT} for c, n_all in counts.items()}
    top = Counter()
    for r in rates.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    sets = {c: {g for g, x in r.items() if x >= langid.SHARE * top[g]} for c, r in rates.items()}
    got = {r["doc_id"]: r for r in registry.op1_language_id(spark, data).collect()}
    compared = 0
    for d, text, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            assert got[d]["lang_pred"] == "und"
            continue
        hits = Counter({c: sum(g in s for g in _grams_brute(text)) for c, s in sets.items()})
        (best, n), (_, second) = hits.most_common(2)
        assert got[d]["held_out"] == held(d)
        if n > 1.05 * second + 1:
            compared += 1
            assert got[d]["lang_pred"] == best and got[d]["score"] == pytest.approx(n / hits.total(), abs=0.02)
    assert compared > 150


def test_bit_slices_and_correction():
    rng = np.random.default_rng(0)
    sets = {c: rng.integers(0, 1 << 62, 3000).astype(np.uint64) for c in "abcdefghij"}  # more than eight languages
    f = langid.Filter.of(sets, slots=1 << 14)
    for k, c in enumerate(f.languages):
        masks = f.masks(sets[c])
        assert (masks[0] >> masks.dtype.type(k) & 1).all()  # no false negatives
    other = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    seen = f.hits(other) / len(other)
    assert np.allclose(seen, f.false_rates(), atol=0.02)


def test_language_pieces():
    text = "Ab cd'efg. hij " * 50
    whole = np.concatenate(list(langid.pieces(text)))
    for size in (7, 64):
        assert np.array_equal(np.sort(np.concatenate(list(langid.pieces(text, size)))), np.sort(whole))


def test_language_odd(odd, none):
    model = langid.fit(odd.select("text", "lang"), min_count=1)
    got = {r["text"]: r for r in langid.predict(odd, model).collect()}
    assert got[None]["lang_pred"] == "und" and got[""]["lang_pred"] == "und" and got["...!!! 123"]["lang_pred"] == "und"
    assert got["word"]["lang_pred"] in ("en", "fr", "ja") and got["word"]["size"] == "x"
    empty = langid.fit(none.select("text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


# ------------------------------------------------------------------ 2


def test_seeds_hit_all_patterns():
    from itertools import combinations

    for n, subs in ((13, 2), (15, 3), (20, 4)):
        places = [{p + o for o in m} for m in decontam.MASKS for p in range(n - m[-1])]
        assert all(any(s.isdisjoint(c) for s in places) for c in map(set, combinations(range(n), subs)))
    for masks in (decontam.MASKS, decontam.LIGHT):  # every mask ignores some position
        assert all(len(m) < m[-1] + 1 for m in masks)


def _fewest_substitutions(masks, most):
    """Of each length: the fewest substitutions that spoil every place of every mask."""
    span = max(m[-1] for m in masks) + 1
    spoiled = [(m[-1] + 1, sum(1 << (m[-1] - o) for o in m)) for m in masks]
    states, out = {0: 0}, {}
    for n in range(1, most + 1):
        then = {}
        for s, cost in states.items():
            for bit in (0, 1):
                t = (s << 1 | bit) & ((1 << span) - 1)
                if all(n < size or t & b for size, b in spoiled):
                    then[t] = min(then.get(t, n), cost + bit)
        states = then
        out[n] = min(states.values())
    return out


def test_seeds_hit_a_fifth_substituted():
    few = _fewest_substitutions(decontam.MASKS, 200)
    assert all(few[n] > n // 5 for n in range(decontam.MIN_TOKENS, 201))
    few = _fewest_substitutions(decontam.LIGHT, 12)
    assert all(few[n] > n // 5 for n in range(4, 13))


def _overlap_brute(x, y):
    need = 13 if len(y) >= 13 else -int(-(0.8 * len(y) - 1e-9) // 1)
    best = None
    for start in range(-len(y) + 1, len(x)):
        a, b = max(0, -start), min(len(y), len(x) - start)
        eq = [y[i] == x[start + i] for i in range(a, b)]
        for s in range(len(eq)):
            for e in range(s + 1, len(eq) + 1):
                if e - s >= need and eq[s] and eq[e - 1] and sum(eq[s:e]) >= 0.8 * (e - s) - 1e-9:
                    row = (e - s, -(start + a + s), sum(eq[s:e]))
                    best = row if best is None else max(best, row)
    return [(7, -best[1], best[0], best[2])] if best else []


def test_overlaps():
    """Rows, not only pairs: first token, tokens and equal tokens, against all alignments."""
    rng, found = random.Random(3), 0
    for _ in range(400):
        some = "abcdefgh"[: rng.randrange(1, 9)]
        y = [rng.choice(some) for _ in range(rng.randrange(1, 24))]
        x = [rng.choice(some + "z") for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.7:
            w = y[rng.randrange(0, len(y)) :]
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(some)
            at = rng.randrange(0, len(x) + 1)
            x[at:at] = w
        got = decontam.Index([(7, " ".join(y))]).overlaps(" ".join(x), 0.8, 13)
        assert got == _overlap_brute(x, y)
        found += len(got)
    assert found > 100


def test_overlaps_short_items_and_repeated_tokens():
    short = decontam.Index([(1, "a b c d"), (2, "q"), (3, "one two three four five"), (4, ""), (5, "u v w")])
    assert sorted(short.overlaps("zz a b c d q one TWO three x five u v w", 0.8, 13)) == [(1, 1, 4, 4), (2, 5, 1, 1), (3, 6, 5, 4), (5, 11, 3, 3)]
    assert [r[0] for r in short.overlaps("zz a b c d q one TWO three x five u v w", 0.8, 13, shortest=5)] == [3]
    began = time.perf_counter()
    assert decontam.Index([(1, "x " * 2000)]).overlaps("x " * 8000, 0.8, 13) == [(1, 0, 2000, 2000)]
    assert decontam.Index([(1, "x y " * 1000)]).overlaps("x y " * 4000, 0.8, 13) == [(1, 0, 2000, 2000)]
    assert time.perf_counter() - began < 5


def test_decontamination_very_long_text_and_clashing_names(spark):
    item = " ".join(f"i{k}" for k in range(20))
    long = " ".join(f"w{k % 5000}" for k in range(600_000)) + " " + item  # over 3 MB
    docs = spark.createDataFrame([(1, long, 5, "x", 0.5)], "doc_id long, text string, item_id int, n_tokens string, similarity double")
    bench = spark.createDataFrame([(3, item, 8)], "item_id long, text string, doc_id int")
    assert [tuple(r) for r in decontam.contamination(docs, bench).collect()] == [(1, 3, 600_000, 20, 20, 1.0)]
    assert decontam.drop_contaminated(docs, bench).count() == 0


def _longest_brute(eq, sim):
    best = None
    for s in range(len(eq)):
        for e in range(s + 1, len(eq) + 1):
            if eq[s] and eq[e - 1] and sum(eq[s:e]) >= sim * (e - s) - 1e-9 and (best is None or e - s > best[1] - best[0]):
                best = (s, e, sum(eq[s:e]))
    return best


def test_longest_overlap():
    rng = random.Random(3)
    for _ in range(400):
        eq = [rng.random() < 0.75 for _ in range(rng.randrange(1, 30))]
        assert decontam.longest(np.array(eq), 0.8) == _longest_brute(eq, 0.8)


def test_decontamination(spark, odd, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)]
    made, want = [], set()
    for d in range(40):
        text = [word() for _ in range(50)]
        if d % 4:
            i = d % 8
            w = items[i][1].split()
            if d % 4 == 2:
                for p in (3, 9, 15, 21, 27):  # every sixth word substituted
                    w[p] = word()
            if d % 4 == 3:
                w = w[:8]  # too short to count
            else:
                want.add((d, i))
            text[10:10] = w
        made.append((d, " ".join(text)))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "one two")], "item_id long, text string")
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for block in (200_000, 60):  # one block, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench, block_tokens=block).collect()}
        assert got == want
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in made} - {d for d, _ in want}
    assert decontam.contamination(odd, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench).count() == len(ODD)
    assert decontam.contamination(none, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).count() == 0


# ------------------------------------------------------------------ 3


def test_arc_versions():
    v1 = warc.version_block(1) + "http://a/ 1.2.3.4 19990102030405 text/html 5\nhello\n"
    v2 = warc.version_block(2) + "http://b/ 1.2.3.4 20010203 text/html 200 - - 0 f.arc 3\nabc\n"
    got = list(warc.parse_arc((v1 + "\n" + v2).encode()))
    assert [(f["URL"], b) for f, b in got if not f["URL"].startswith("filedesc")] == [("http://a/", b"hello"), ("http://b/", b"abc")]
    assert warc.iso_date("19990102030405") == "1999-01-02T03:04:05Z" and warc.iso_date("20010203") == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"garbage line\n"))
    assert [b for _, b in warc.parse_arc(b"garbage line\n" + v1.encode(), "skip")][-1] == b"hello"
    with pytest.raises(ValueError):
        list(warc.parse_arc(v1.encode()[:-4]))
    page = v1 + "filedesc://x 1.2.3.4 19990102030405 text/html 3\nabc\n"  # a page of that kind of URL
    assert [(f["URL"], b, v) for f, b, v in warc.arc_records(page.encode())][1:] == [("http://a/", b"hello", False), ("filedesc://x", b"abc", False)]


def test_arc_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\x00raw"  # not UTF-8
    arc = warc.version_block(1).encode() + b"http://a/ 1.2.3.4 19990102030405 text/html %d\n" % len(body) + body + b"\n"
    (tmp_path / "x.arc.gz").write_bytes(gzip.compress(arc))
    records = warc.mark_revisits(warc.read_arc(spark, str(tmp_path)))
    warc.write_warc(records, str(tmp_path / "w"))
    back = {r["warc_type"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert back["response"]["payload"] == b"\xff\x00raw" and back["response"]["date"] == "1999-01-02T03:04:05Z"
    assert "warcinfo" in back


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 150
    pages = [(5, "http://a/", big), (3, "http://b c/", big), (9, None, big), (4, "u", "small"), (6, "u", "small"), (7, "", None), (8, "u", "WARC/1.1\r\n\r\n\r\n" + big), (3, "again", big), (None, "u", big), (11, "filedesc://x", big), (12, "filedesc://y z", "1 0 p\nURL IP-address\n"), (13, "warcinfo:", "2")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "head": F.lit(1), "payload": F.lit(2)}).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = registry.op3_warc(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(pages)
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = sorted((str(i), len((h or "").encode()), sha(h), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, _, h in pages)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/e/pages.parquet")
    assert registry.op3_warc(spark, f"file://{tmp_path}/e").count() == 0


# ------------------------------------------------------------------ 4


def _license_brute(text):
    import re

    split = lambda t: re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()
    grams = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    w, out = split(text), set()
    for name, t in licenses.TEMPLATES:
        want = grams(split(t))
        b = max(4, 1 << (len(want) - 1).bit_length())
        for s in range(0, max(1, len(w) - 4), b):
            if len(grams(w[s : s + 2 * b + 4]) & want) >= 0.8 * len(want):
                out.add(name)
    return out


def _license_any_place(text):
    """Templates that some stretch of as many shingles holds, at any place."""
    import re

    split = lambda t: re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    own, out = grams(split(text)), set()
    for name, t in licenses.TEMPLATES:
        want = set(grams(split(t)))
        hit = [g in want for g in own]
        if any(len(set(own[s : s + len(want)]) & want) >= 0.8 * len(want) for s in range(len(own)) if hit[s]):
            out.add(name)
    return out


def test_license_scan(spark, docs, rows, odd, none):
    t = licenses.template_table(spark)
    extra = [(900 + i, f"some words before it. {text.upper()} and after, {i}") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    long = licenses.TEMPLATES[7][1].split()
    long[20] = "changed"
    extra.append((990, " ".join(long)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r["doc_id"], r["template_id"]) for r in licenses.scan(both, t).collect()}
    assert got == {(d, name) for d, x in [*rows, *extra] for name in _license_brute(x)}
    assert {d for d, _ in got} >= {d for d, _ in extra}
    assert got >= {(d, name) for d, x in [*rows, *extra] for name in _license_any_place(x)}  # no grid of windows
    assert licenses.scan(odd, t).count() == 0 and licenses.scan(none, t).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, licenses.template_table(spark, [("x", "too short")]))


# ------------------------------------------------------------------ 5


def _topk_brute(vectors, k=5):
    q = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in vectors}
    out = set()
    for i in q:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("block", [topk.BLOCK_BYTES, 64])
def test_topk(spark, block):
    rng = random.Random(2)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(3)]) for i in range(220)]  # many ties
    bad = [(500, None), (550, [1.0, None, 0.0]), (600, [float("nan"), 0.0, 0.0]), (650, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    e = spark.createDataFrame([*vectors, *bad], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(5)
    rows = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    got = topk.search(rows.where("vec_id % 50 = 0"), rows, block_bytes=block)
    assert {tuple(r) for r in got.collect()} == _topk_brute(vectors)
    if block != 64:
        assert {tuple(r) for r in topk.exact_top_k(e).collect()} == _topk_brute(vectors)
        assert topk.exact_top_k(e.limit(0)).count() == 0
        assert topk.exact_top_k(e.where("vec_id = 50")).count() == 0
        huge = spark.createDataFrame([(0, [1e16, 1e16]), (1, [1e16, 3e15]), (2, [-1e16, 0.0])], "vec_id long, embedding array<double>")
        assert [(r["vec_id"], r["score"]) for r in topk.exact_top_k(huge).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
        exact = [(0, [(2.0**31 + 1) / 256, 0.0]), (1, [(2.0**30 + 1) / 256, 1e307]), (2, [1.0, 0.0]), (50, [1e307, 1.0]), (3, [0.0, 3.0])]
        got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.exact_top_k(spark.createDataFrame(exact, "vec_id long, embedding array<double>")).collect()}
        assert got[0, 1] == (2**31 + 1) * (2**30 + 1) and got[0, 2] == (2**31 + 1) * 256 and got[0, 3] == 0
        assert got[50, 1] == got[50, 2] == (1 << 63) - 1 and got[50, 3] == 3 * 256 * 256


# ------------------------------------------------------------------ 6


def _dedup_brute(docs):
    seen, out = {}, {}
    order = sorted(set((d if d is not None else 1 << 63, t) for d, t in docs), key=lambda x: (x[0],))
    for d, t in order:
        b = (t or "").encode()
        cov = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cov[p : p + 100] = True
            else:
                seen[w] = True
        runs = int(cov[0]) + int((cov[1:] & ~cov[:-1]).sum()) if len(cov) else 0
        out[d, t] = (len(b), int(cov.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cov].tobytes()).hexdigest())
    return out


def _check_dedup(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash")).repartition(3)
    got = suffix_dedup.dedup(frame, **options).collect()
    want = _dedup_brute(docs)
    assert len(got) == len(docs)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 63, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((d if d is not None else 1 << 63, *want[d if d is not None else 1 << 63, t]) for d, t in docs)
    for r in got:
        assert r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"]) and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY, 2])
def test_suffix_dedup(spark, heavy, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)  # 2: hardly a hash that is not split into windows
    monkeypatch.setattr(suffix_dedup, "SAMPLE", suffix_dedup.SAMPLE if heavy > 2 else 1)
    rng = random.Random(heavy)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(0, 3)):
            b = rng.choice(base)
            a = rng.randrange(0, 80)
            parts += [b[a : a + rng.randrange(60, 250)], " ".join(word() for _ in range(rng.randrange(0, 20)))]
        docs.append((d, "".join(parts)))
    docs += [(100, "x" * 700), (101, "y" * 99), (102, "x" * 100), (103, None), (104, ""), (105, docs[3][1]), (106, "ab" * 300), (107, "é" * 130), (None, docs[5][1] + "tail" * 30)]
    _check_dedup(spark, docs)


def test_suffix_dedup_odd(spark, none):
    one = "repeated row with more than a hundred bytes of text in it, so that it has some windows of its own to compare with"
    frame = spark.createDataFrame([(1, one), (1, one), (2, one)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(frame).collect()) == [(1, 0), (1, 0), (2, len(one))]
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("block_tokens", [decontam.BLOCK_TOKENS, 20])
def test_drop_contaminated_judges_rows(spark, block_tokens):
    """Clean rows stay that share a null or other doc_id with a contaminated one."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(3)]
    clean = "a clean text that holds none of the items and is long enough to be searched by all of the masks"
    rows = [(None, f"so {items[0][1]} it goes"), (None, clean), (7, clean), (7, items[2][1]), (8, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.drop_contaminated(docs, bench, block_tokens=block_tokens).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[1], rows[2], rows[4]]))


def test_suffix_dedup_equal_rows_in_one_task(spark):
    one = "repeated row with more than a hundred bytes of text in it, so that it has some windows of its own to compare with"
    rows = [(1, one), (1, one), (2, one), (None, one[::-1]), (None, one[::-1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.dedup(frame).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, len(one))]


def test_deep_shallow_sort():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(40)) * 6 + "".join(rng.choice("ab") for _ in range(300))
    size, n = 100, len(text) - 100
    at = np.arange(n)
    group = np.array([rng.randrange(2) for _ in range(n)])
    order, same = suffixsort.sort_windows(np.frombuffer(text.encode() + bytes(8), np.uint8), group, at, size)
    keys = [(group[i], text[i : i + size]) for i in order]
    assert keys == sorted((g, text[i : i + size]) for i, g in enumerate(group))
    assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]


# ------------------------------------------------------------------ 7


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary_path())


TEXTS = ["", " ", "Hello, world's WE'LL don't", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "ΑΣ ΣΑΣ İstanbul ǅ é x́", "日本語 テスト 123 ½ ² Ⅷ", "x y\x1cz\x85w\xa0q", "😀😀 ok", "x" * 500, "\x00\x01 tab\tline\n"]


def test_token_counts(spark, rows, library):
    texts = [t for _, t in rows] + TEXTS
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(len(texts), None, 1)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in tokencount.token_counts(frame, registry.vocabulary_path(), limit=100).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert got[len(texts)]["n_tokens"] == 0 and got[0]["over_limit"] == (want[0] > 100)
    assert got[3]["n_bytes"] == len(texts[3].encode())
    assert tokencount.token_counts(frame.limit(0), registry.vocabulary_path()).count() == 0


def test_token_counts_unicode(library):
    """All code points, each between letters, and random strings of old and new scripts."""
    c = tokencount.counter(registry.vocabulary_path())
    texts = [f"a{chr(i)}b {chr(i)}1{chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng = random.Random(1)
    pools = [range(0x20, 0x7F), range(0xA0, 0x600), [*range(0x300, 0x370), *range(0x41, 0x5B)], range(0x900, 0x1200), [*range(0x2000, 0x2070), 32, 9, 10, 0x1C, 0x85], range(0xE000, 0x110000), [0x1904E, 0x18DB1, 0x32808, 0x10D, 0x100, 0x61, 0x3F]]
    texts += ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 24))) for _ in range(100_000)]
    texts.append("very long " + "word é 漢 x1 " * 300_000)
    count = lambda t: int((r := c.running(t))[-1]) if c.chunks(t) else 0  # noqa: E731, F841
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, n in zip(texts, want) if count(t) != n] == []


def test_token_vocabularies_refused(tmp_path):
    import json

    spec = json.load(open(registry.vocabulary_path(), encoding="utf-8"))
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"model": spec["model"] | {"byte_fallback": True}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            tokencount.PrefixCounter(str(tmp_path / "other.json"))


def test_token_prefixes(rows, library):
    c = tokencount.counter(registry.vocabulary_path())
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for word in ["internationalisation", "thereingouble", "aaaaaaaaaaaa", "zqxjkvbp", "1"]:
        assert c.prefixes(word)[1:] == [n(word[:i]) for i in range(1, len(word) + 1)]
    text = rows[0][1]
    chunks = text.split()
    table = c.running(text)
    for k in (1, len(chunks) // 2, len(chunks)):
        assert table[k - 1] == n(" ".join(chunks[:k]))
    whole, words, inside = c.longest_prefix(text, 57)
    kept = " ".join(chunks[:whole]) + " " + "".join(w for w in c.words(chunks[whole])[:words]) + c.words(chunks[whole])[words].encode()[:inside].decode("utf-8", "ignore")
    assert n(kept) <= 57 < n(" ".join(chunks[: whole + 1]))


# ------------------------------------------------------------------ 8


def test_sharding(spark, docs, odd, none):
    for frame, shards in ((docs, 40), (odd, 4), (odd, 40)):
        got = sharding.external_shuffle(frame, shards=shards).collect()
        assert len(got) == frame.count()
        counts = {}
        for r in got:
            counts.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in counts.values())
        sizes = [len(counts.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and min(counts) == 0
        assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in got)
    again = lambda f, n: sorted((str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"]) for r in sharding.external_shuffle(f.repartition(n)).collect())
    assert again(docs, 2) == again(docs, 5)
    assert sharding.external_shuffle(none).count() == 0
    order = [r["doc_id"] for r in sharding.external_shuffle(docs, shards=1).orderBy("slot").collect()]
    assert order != sorted(order) and abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def plain_shuffle(spark, rows, shards=40, seed=sharding.SEED):
    """(id, text) -> (id, text, shard, slot) by the rules of the two passes, without them."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"))
    buckets = max(sharding.MIN_BUCKETS, -(-sum(len((t or "").encode()) + 16 for _, t in rows) // sharding.BUCKET_BYTES))
    own = {}
    for d, t, h in frame.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text", "size")).collect():
        own.setdefault(h % buckets, []).append((d, t))
    out = []
    for b in range(buckets):
        order = sorted(own.get(b, []), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))
        rng = np.random.Generator(np.random.PCG64([seed, b]))
        for i in reversed(range(1, len(order))):
            j = int(rng.integers(0, i + 1))
            order[i], order[j] = order[j], order[i]
        out += order
    return [(d, t, p % shards, p // shards) for p, (d, t) in enumerate(out)]


def test_sharding_scatters_repeated_rows(spark, tmp_path):
    """Rows that repeat id and text are a third of all; none of their buckets is overfull."""
    rows = [(None, "")] * 4000 + [(k, f"text {k}") for k in range(8000)] + [(5, "same")] * 2000
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id() % 5)
    results = []
    for n in (3, 7):
        frame.repartition(n).write.parquet(f"file://{tmp_path}/{n}")
        got = sharding.external_shuffle(spark.read.parquet(f"file://{tmp_path}/{n}")).collect()
        results.append(sorted((str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in got))
        counts = [sum(r["shard"] == s for r in got) for s in range(40)]
        assert len(got) == len(rows) and max(counts) - min(counts) <= 1
        assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    assert results[0] == results[1]
    sized = frame.withColumn("__mixed", F.xxhash64("doc_id", "text")).withColumn("__bucket", F.pmod("__mixed", F.lit(64)).cast("int"))
    before = sharding._counts(sized, 64)
    after = sharding._counts(sharding._scatter_repeats(sized, [b for b, n in enumerate(before) if n > 900], 900, 64), 64)
    assert sum(after) == len(rows) and max(after) < 400 < max(before)


def test_sharding_against_plain_shuffle(spark, docs, rows, odd):
    some = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda r: (str(r[0]), r[1] or "", r[2], r[3])
    for frame, plain, shards in ((docs, rows, 40), (odd, some, 3)):
        got = [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.external_shuffle(frame, shards=shards).collect()]
        assert sorted(got, key=key) == sorted(plain_shuffle(spark, plain, shards), key=key)


# ------------------------------------------------------------------ 9


def test_raking(spark):
    cells = [("a", "en", "x", 100), ("a", "fr", "x", 50), ("b", "en", "y", 30), ("b", "fr", "x", 20), ("a", "en", "y", 10), ("b", "en", "x", 5), ("a", "fr", "y", 5), ("b", "fr", "y", 5)]
    frame = spark.createDataFrame(cells, "__source string, __lang string, __topic string, tokens long")
    t = lambda d: spark.createDataFrame(list(d.items()), "value string, target double")
    aims = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "fr": 0.3}, "topic": {"x": 0.4, "y": 0.6}}
    got = mixing.rake(frame, {k: t(v) for k, v in aims.items()}, rounds=40).collect()
    for d, aim in aims.items():
        for value, share in aim.items():
            assert sum(r["weight"] for r in got if r[f"__{d}"] == value) == pytest.approx(share, abs=1e-6)


def test_mixing_meets_budget_and_targets(spark):
    """Cells that are kept whole leave their share to the others; marginals are met, or their miss shown."""
    rows = [(k, "x" * 4, "small" if k < 40 else "large", "en" if k % 3 else "fr") for k in range(4000)]
    docs = mixing.described(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    for budget in (0.02, 0.6, 1.5):
        every = mixing.calibrated(docs, budget).collect()
        assert sum(r["__tokens"] * r["__prob"] for r in every) == pytest.approx(min(1.0, budget) * 4000)
        assert (budget < 0.5) != any(r["__prob"] == 1.0 for r in every)
    seen = mixing.marginals(docs, 0.02).collect()
    assert all(r["target"] == pytest.approx(r["weight"], abs=1e-9) and r["target"] == pytest.approx(r["share"], abs=1e-9) for r in seen)
    late = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs, 0.6).collect()}
    assert late["source", "small"]["share"] < late["source", "small"]["target"]


def test_mixing(spark, docs, odd, none):
    every = mixing.calibrated(mixing.described(docs)).collect()
    kept = mixing.mix(docs).collect()
    want = sum(r["__tokens"] * r["__prob"] for r in every)
    spread = sum(r["__tokens"] ** 2 * r["__prob"] * (1 - r["__prob"]) for r in every) ** 0.5
    assert abs(sum(r["__tokens"] for r in kept) - want) < 4 * spread  # a draw a document
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in mixing.mix(docs.repartition(3)).collect()}
    got = mixing.mix(odd, budget=1e9)
    assert got.count() == len(ODD) and set(odd.columns) <= set(got.columns)  # every probability is 1
    assert mixing.mix(none).count() == 0
    unnamed = spark.createDataFrame([(None, f"text {k}", "s", "en") for k in range(2000)], "doc_id long, text string, source string, lang string")
    assert 1000 < mixing.mix(unnamed, budget=0.6).count() < 1400  # each by its own text


# ------------------------------------------------------------------ 10


def _fingerprint_brute(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components_brute(items, radius):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = np.array([f for _, f in items], dtype=np.uint64)
    for i in range(len(items)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(items):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(items)]


def test_simhash(spark, docs, rows):
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(_components_brute([(d, _fingerprint_brute(t)) for d, t in rows], 4))


@pytest.mark.parametrize(("tile_rows", "part_rows"), [(4096, 4096), (1, 4096), (4096, 30)])
def test_simhash_links(spark, tile_rows, part_rows):
    rng = random.Random(4)
    fps = []
    for c in range(30):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.append(f)
            for _ in range(rng.randrange(0, 7)):
                f ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f, f if k % 7 else None) for k, f in enumerate(signed)], "fp long, first_id long").repartition(3)
    edges = simhash.link(frame, tile_rows=tile_rows, part_rows=part_rows)
    label = {r["node"]["fp"]: r["component"]["fp"] for r in components.connected_components(edges).collect()}
    got, want = {}, {}
    for (i, _, c), s in zip(_components_brute(list(enumerate(fps)), 4), signed):
        want.setdefault(c, set()).add(i)
        got.setdefault(label.get(s, s), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(simhash.block_masks(10, 4, 4096)) == 5 and len(simhash.block_masks(10**9, 4, 4096)) == 15


def test_simhash_large_tile():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 1500, 2)).astype(np.uint64)
    fps = np.unique(np.concatenate([(centre[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel(), rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    assert len(fps) > 4 * simhash.SIDE
    root = simhash.link_tile(fps)
    want = _components_brute(list(enumerate(fps.tolist())), 4)
    low = {}
    for i, _, c in want:
        low.setdefault(c, []).append(int(fps[i]))
    assert all(int(fps[root[i]]) == min(low[c]) for i, _, c in want)


def test_simhash_odd(odd, none):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    zero = {r for r in got if r[1] == "0" * 16}
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1)} <= zero
    assert {r[2] for r in got if r[0] == 10} == {7}
    assert simhash.near_duplicates(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 1000 + i) for i in range(50)] + [(7, 7), (3, None)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(50)} == {500}
