"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Texts become lower-cased words and five-word shingles. For a template of s shingles,
windows of 2B shingles start every B shingles, B the least power of two of at least
max(4, s), so each run of s shingles lies whole in a window. A window retrieves a template
if one of BANDS MinHash values agrees (a row a band). An occurrence with containment 0.8
has a Jaccard similarity of at least 0.8 s / (2B + 0.2 s) with its window, no less than 1/10;
64 bands then miss it with probability below 0.002, and an unchanged one of s = B with
probability below 1e-18. Retrieved windows are verified on the shingles' words.

A window's MinHash value can only equal a template's if the window holds the shingle that
gives the template its value, so only windows around such shingles are hashed; that filter
changes no result. All of it is DataFrame functions; documents are never shuffled.

Null and empty texts and texts of fewer than five words have no shingles and give no rows.
Rows that share a doc_id are reported as one. Of several places the best containment is
given, and the first window that reaches the threshold. A text that differs from a template
by little (another version number) is reported under both, each with its containment.
Templates of fewer than five words are refused. Only doc_id and text are read, so other
columns may have any name. An empty table gives no rows. TEMPLATES are short notices and
grants; full license texts are given as `templates` by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemeter.llm.common import cut

K = 5
BANDS = 64
SIMILARITY = 0.8
#: Templates are collected and become literals; more must come in several calls.
MAX_TEMPLATES = 500

#: Notices and clauses as their publishers word them.
TEMPLATES = (
    ("CC-BY-NC-4.0/notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0/notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0/notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0/header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0/notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0/header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT/notice", "Released under the MIT License."),
    ("MIT/grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD/grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD/disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("MIT/disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("GPL-2.0/header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1/header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0/header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0/header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC/grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib/text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense/text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0/notice", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0/notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0/work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when((plain == "") | plain.isNull(), F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _shingled(w: Column, of) -> Column:
    n = F.size(w) - K
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: of(*(F.get(w, i + d) for d in range(K)))))


def hashes(w: Column) -> Column:
    return F.coalesce(_shingled(w, F.xxhash64), F.array().cast("array<bigint>"))


def phrases(w: Column) -> Column:
    return F.coalesce(_shingled(w, lambda *x: F.concat_ws(" ", *x)), F.array().cast("array<string>"))


def signature(h: Column, bands: int = BANDS) -> Column:
    """Structs (value, shingle): a MinHash value a band and the shingle that gives it."""
    least = lambda h, j: F.array_min(F.transform(h, lambda x: F.struct(F.xxhash64(j, x).alias("value"), x.alias("shingle"))))
    return _let(h, lambda own: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: least(own, j)))


def block_size(shingles: Column) -> Column:
    return F.greatest(F.lit(4), F.pow(F.lit(2.0), F.ceil(F.log2(shingles.cast("double")))).cast("int"))


def template_table(spark: SparkSession, templates=TEMPLATES, bands: int = BANDS) -> DataFrame:
    """(template_id, phrases, sig, block), written once."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates a call")
    rows = spark.createDataFrame(list(templates), "template_id string, text string").select("template_id", words(F.col("text")).alias("w"))
    made = rows.select("template_id", F.array_distinct(phrases(F.col("w"))).alias("phrases"), F.array_distinct(hashes(F.col("w"))).alias("h"))
    return cut(made.select("template_id", "phrases", signature(F.col("h"), bands).alias("sig"), block_size(F.size("h")).alias("block"), F.size("h").alias("n")), "templates")


def scan(docs: DataFrame, templates: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, template_id, containment, n_windows, first_word): the best
    containment, the windows that reach `similarity`, and where the first one starts."""
    if templates.where("n = 0").count():
        raise ValueError(f"a template needs {K} words")
    keys = [r[0] for r in templates.select(F.explode("sig.shingle")).distinct().collect()]  # bounded: bands times MAX_TEMPLATES
    blocks = sorted(r[0] for r in templates.select("block").distinct().collect())
    marks = lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(keys), i)), lambda i: i.isNotNull())
    src = docs.select("doc_id", "text").withColumn("marks", _let(words(F.col("text")), lambda w: marks(hashes(w))))
    marked = src.where(F.size("marks") > 0).withColumn("w", words(F.col("text"))).drop("text")

    def windows(b: int) -> Column:
        at = F.array_distinct(F.flatten(F.transform("marks", lambda i: F.array(F.floor(i / b), F.floor(i / b) - 1))))
        return F.transform(F.filter(at, lambda k: k >= 0), lambda k: F.struct(F.lit(b).alias("block"), (k * b).cast("int").alias("start")))

    at = marked.select("doc_id", "w", F.explode(F.concat(*(windows(b) for b in blocks))).alias("at"))
    cut_out = at.select("doc_id", "at.block", "at.start", F.slice("w", F.col("at.start") + 1, 2 * F.col("at.block") + K - 1).alias("part"))
    signed = cut_out.select("doc_id", "block", "start", F.array_distinct(phrases(F.col("part"))).alias("own"), signature(hashes(F.col("part")), bands).alias("sig"))
    banded = signed.select("doc_id", "block", "start", "own", F.posexplode("sig.value").alias("band", "value"))
    wanted = templates.select("template_id", "phrases", "block", F.posexplode("sig.value").alias("band", "value"))
    found = banded.join(wanted, ["block", "band", "value"])
    share = F.size(F.array_intersect("own", "phrases")) / F.size("phrases")
    verified = found.select("doc_id", "template_id", "start", share.alias("share")).where(F.col("share") >= similarity)
    return verified.groupBy("doc_id", "template_id").agg(F.round(F.max("share"), 6).alias("containment"), F.countDistinct("start").alias("n_windows"), F.min("start").alias("first_word"))


def scan_sql(templates=TEMPLATES, similarity: float = SIMILARITY, table: str = "documents") -> str:
    """DuckDB SQL of the query's rows: every window of the grid, by joining shingles."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in templates)
    split = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda z: z <> '')"
    shingles = f"list_transform(range(0, len(w) - {K - 1}), lambda i: array_to_string(w[i + 1:i + {K}], ' '))"
    return f"""
WITH t AS (SELECT name AS template_id, {split.format('text')} AS w FROM (VALUES {listed}) v(name, text)),
s AS (SELECT template_id, list_distinct({shingles}) AS p FROM t),
g AS (SELECT template_id, unnest(p) AS phrase, len(p) AS n, greatest(4, CAST(pow(2, ceil(log2(len(p)))) AS INT)) AS b FROM s),
d AS (SELECT doc_id, {split.format('text')} AS w FROM {table} WHERE text IS NOT NULL),
o AS (SELECT doc_id, unnest({shingles}) AS phrase, unnest(range(0, len(w) - {K - 1})) AS pos FROM d WHERE len(w) >= {K}),
h AS (SELECT doc_id, template_id, n, b, phrase, unnest([pos // b, pos // b - 1]) AS k FROM o JOIN g USING (phrase)),
c AS (SELECT doc_id, template_id, k * b AS start, count(DISTINCT phrase) / CAST(n AS DOUBLE) AS share FROM h WHERE k >= 0 GROUP BY doc_id, template_id, k, b, n)
SELECT doc_id, template_id, round(max(share), 6) AS containment, count(*) AS n_windows, CAST(min(start) AS INT) AS first_word FROM c WHERE share >= {similarity} GROUP BY doc_id, template_id
"""
