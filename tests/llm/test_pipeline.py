"""The pipeline's stages on planted cases, on odd tables, and its rows against the stages applied by hand."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosemeter.llm import mixing, registry, simhash, simhash_texts
from tests.llm.test_operators import DOCS, ODD, _overlap_brute, plain_shuffle


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["the", "ing", "ou", "er", "st", "an"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs = [(i, text(80), "en", f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "s0") for i in range(20)]  # copies
    docs += [(300 + i, text(20) + " " + items[i][1] + " " + text(20), "en", "s1") for i in range(5)]  # leaks
    docs += [(400, "12345 !!! 678", "en", "s1"), (401, None, "en", "s1"), (402, "漢字だけの文章です " * 9, None, "s1")]
    path = f"file://{tmp_path_factory.mktemp('planted')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, planted).cache()
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "shards":
            assert docs.columns == columns
    everything = set(range(120)) | set(range(200, 220)) | set(range(300, 305)) | {400, 401, 402}
    assert seen["language_id"] == everything - {400, 401, 402}
    assert seen["near_dedup"] == seen["language_id"] - set(range(200, 220))
    assert seen["decontamination"] == seen["near_dedup"] - set(range(300, 305))
    assert seen["mixture"] <= seen["decontamination"] and len(seen["mixture"]) > 30
    assert seen["shards"] == seen["mixture"]


def _jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_dedup_edited_copies(spark):
    """Copies with words changed, against brute force over all pairs."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(40)]
    rows = []
    for i, words in enumerate(base):
        other = list(words)
        for j in rng.sample(range(150), i % 6):
            other[j] = "changed"
        rows += [(i, " ".join(words)), (100 + i, " ".join(other))]
    near = {b for (a, x) in rows for (b, y) in rows if a < b and _jaccard(x, y) >= 0.8}
    assert 10 < len(near) < 40  # some are edited too much
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {d for d, _ in rows} - near


@pytest.mark.parametrize("parts", [None, 300])
def test_similar_texts(spark, parts, monkeypatch):
    """Chains, copies and short texts against brute force; small parts split every group."""
    if parts:
        monkeypatch.setattr(simhash_texts, "PART_SHINGLES", parts)
        monkeypatch.setattr(simhash_texts, "SPREAD_SHINGLES", 50)
        monkeypatch.setattr(simhash_texts, "deal", lambda k, keys, name, rows=20, spread=3, weight="1": simhash.deal(k, keys, name, rows, spread, weight))
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    texts = [[f"w{k}"] for k in range(5)] + [words(3) for _ in range(3)] + [words(12) for _ in range(20)]
    for _ in range(12):
        base = words(rng.choice([9, 60, 200]))
        for _ in range(12):  # a chain: each a little off the last
            texts.append(list(base))
            base[rng.randrange(len(base))] = "changed"
    hub = words(120)
    for _ in range(60):
        copy = list(hub)
        for p in rng.sample(range(120), rng.randrange(0, 5)):
            copy[p] = f"w{rng.randrange(9000)}"
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", "  ", "W1 w2 w3 w4 w5 w6", "w1 W2 w3 w4 w5 w6"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(999, None), (1000, texts[0])], "doc_id long, text string").repartition(3)
    names = {r["text"]: r["node"] for r in docs.select("text", F.xxhash64("text").alias("node")).collect()}
    label = {r["node"]: r["component"] for r in simhash_texts.similar_texts(docs).collect()}
    distinct = list(names)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in distinct]
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    want = {}
    for i, t in enumerate(distinct):
        want.setdefault(find(i), set()).add(names[t])
    got = {}
    for n in names.values():
        got.setdefault(label.get(n, n), set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_run(spark, planted):
    """The pipeline's rows against stages done by hand: pairs by Jaccard, all alignments of items,
    DuckDB for the raking and the draw, and a plain shuffle."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{planted}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    left = [d for d in sorted(docs) if d < 400]  # 400 to 402 are in none of the languages
    left = [d for d in left if not any(e < d and _jaccard(docs[d]["text"], docs[e]["text"]) >= 0.8 for e in left)]
    left = [d for d in left if not any(_overlap_brute(docs[d]["text"].split(), x.split()) for x in items)]
    documents = pd.DataFrame([{"doc_id": d, "text": docs[d]["text"], "lang": docs[d]["lang"], "source": docs[d]["source"]} for d in left])  # noqa: F841
    kept = duckdb.sql(mixing.mix_sql()).fetchall()
    want = plain_shuffle(spark, [(r[0], docs[r[0]]["text"]) for r in kept])
    for got in (corpus_pipeline.run(spark, planted), registry.QUERIES["pipeline"](spark, planted)):
        assert sorted(tuple(r) for r in got.select("doc_id", "text", "shard", "slot").collect()) == sorted(want)


def test_scratch_is_removed(spark, planted):
    base = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir').removeprefix('file://')}/prosemeter"
    before = set(os.listdir(base))
    corpus_pipeline.run(spark, planted).count()
    assert len(set(os.listdir(base)) - before) <= 1  # what the last stage reads
    tables = spark.catalog.listTables()
    registry.QUERIES["op6_suffix_dedup"](spark, planted).count()
    assert spark.catalog.listTables() == tables


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd(spark, tmp_path, rows):
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, None), (1, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    assert len(got) <= len(rows)


def test_shared_folder(spark):
    assert os.path.isdir(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
