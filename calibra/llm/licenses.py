r"""License scans: an exact set-similarity join of text blocks with license templates. DataFrame operations only.

A template of T words is looked for in blocks of 2 C consecutive words, over line ends, that begin
at every C-th word; C is T rounded up to a power of two, so any C words that stand together lie
whole in one block. Words are runs of ASCII letters (lowered), digits and non-ASCII characters. A
block carries a template when it holds at least THRESHOLD percent of the template's distinct words,
all that tell it from its near kin and none that rule it out. As a block is never longer than four templates, words
scattered over a long line do not add up.

One pass over the corpus makes the words, the base labels and, for each document, the template
words it holds; documents that hold too few of every template keep no words (no block can hold
more than its document). The join on what is left is exact and filtered three ways:

- prefix: template words are ordered by their number of documents in the whole corpus, rarest
  first. A block that reaches the threshold must hold one of the first size - need + 1, so only
  blocks with such a word are joined;
- length: such a block has at least `need` words of the templates, and blocks are sized to them;
- position: a pair whose rarest shared word has place p in the template shares at most
  size - p words, and at most the block's own template words from there on.

Survivors are verified by counting. Templates are a constant of the operator (a small table,
broadcast), and the result of the join is one row for each document with a hit.

The base labels are exact phrases of consecutive words, over line ends too. Null text is empty: no
words, no labels, score 0. Repeated rows get equal results each. Other columns are ignored.
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved, table

THRESHOLD = 90
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Label, public license notice or text, and words that tell it from its near kin: +word must be in the block, -word must not.
TEXTS = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version", "+affero"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ""),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ""),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ""),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0.", ""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "-noncommercial -sharealike -noderivatives -noderivs"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ""),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "+noncommercial -sharealike -noderivatives -noderivs"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "+sharealike -noncommercial"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version", "-lesser -affero -library"),
    ("gpl", "This work is licensed under the GNU General Public License", "-lesser -affero -library"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version", "+lesser"),
    ("mit", "Released under the MIT License", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ""),
    ("proprietary", "All rights reserved", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ""),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ""),
]
#: What parts words: all ASCII characters but digits and lower-case letters.
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]  # distinct, sorted
    must: tuple[str, ...]
    without: tuple[str, ...]
    span: int  # words of a stride; a block has twice as many
    need: int


def template(label: str, text: str, kin: str = "", threshold: int = THRESHOLD) -> Template:
    every = [w for w in re.split(_PARTS, text.lower()) if w]
    words = tuple(sorted(set(every)))
    must, without = (tuple(w[1:] for w in kin.split() if w[0] == sign) for sign in "+-")
    return Template(label, words, must, without, 1 << (len(every) - 1).bit_length(), -(-threshold * len(words) // 100))


TEMPLATES = [template(*t) for t in TEXTS]


def _lowered(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _PARTS), "")


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def phrase_places(words: Column, phrase: str) -> Column:
    """Word positions, from 0, where the phrase's words stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def outlines(docs: DataFrame, templates: list[Template], key: str) -> DataFrame:
    """key, id, n_words, the base columns, held (template words the document has), spans and w (its words, where a template may be met)."""
    vocabulary = sorted({w for t in templates for w in (*t.words, *t.without)} | {w for p in PHRASES.values() for w in p.split()})
    rows = docs.select(F.col(key), _words(_lowered()).alias("w")).withColumn("held", F.array_intersect(_texts(vocabulary), "w"))
    none = F.array().cast("array<int>")
    has = lambda words: F.size(F.array_intersect(_texts(words), "held"))
    places = [F.when(has(sorted(set(p.split()))) == len(set(p.split())), phrase_places(F.col("w"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(PHRASES.values())]
    met = [F.when((F.size("held") >= t.need) & (has(t.words) >= t.need), t.span) for t in templates]
    rows = rows.select(key, "w", "held", *places, F.array_distinct(F.array_compact(F.array(*met))).alias("spans"))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    named = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, label) for i, label in enumerate(PHRASES))))
    return rows.select(
        key, F.monotonically_increasing_id().alias("id"), F.size("w").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(named).alias("base"),
        "held", "spans", F.when(F.size("spans") > 0, F.col("w")).alias("w"),
    )


def word_order(rows: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words by the number of documents that hold them, rarest first; ties by the word."""
    count = {r["word"]: r["n"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted({w for t in templates for w in t.words}, key=lambda w: (count.get(w, 0), w))


def _near_blocks(span: int, known: list[str], least: int, rare: list[str]) -> Column:
    """The known words of each block, in the order of `known`, for blocks with `least` of them and a rare one."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / span).cast("int")), lambda i: F.array_intersect(_texts(known), F.slice("w", i * span + 1, 2 * span)))
    return F.filter(pieces, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, _texts(rare)))


def template_hits(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """id, label, shared and size of every (block, template) that meets the threshold; rows: outlines()."""
    order = word_order(rows, templates)
    rank = {w: i for i, w in enumerate(order)}
    prefixes, blocks = [], None
    for span in sorted({t.span for t in templates}):
        own = [t for t in templates if t.span == span]
        rare = set()
        for t in own:
            words = sorted(t.words, key=rank.__getitem__)
            ahead = words[: len(words) - t.need + 1]
            rare |= set(ahead)
            prefixes += [(span, w, t.label, p, len(words), t.need, words, list(t.must), list(t.without)) for p, w in enumerate(ahead)]
        known = [*sorted({w for t in own for w in t.words}, key=rank.__getitem__), *sorted({w for t in own for w in t.without})]
        least, rare = min(t.need for t in own), sorted(rare, key=rank.__getitem__)
        near = _near_blocks(span, known, least, rare)
        part = rows.where(F.array_contains("spans", span)).select("id", F.lit(span).alias("span"), F.explode(near).alias("own"))
        part = part.select("id", "span", "own", F.explode(F.array_intersect("own", _texts(rare))).alias("word"))
        blocks = part if blocks is None else blocks.unionByName(part)
    prefix = rows.sparkSession.createDataFrame(prefixes, "span int, word string, label string, place int, size int, need int, words array<string>, must array<string>, without array<string>")
    seeds = blocks.join(F.broadcast(prefix), ["span", "word"])
    long_enough = F.size("own") >= F.col("need")
    left = F.least(F.col("size") - F.col("place"), F.size("own") - F.array_position("own", F.col("word")) + 1)
    near = seeds.where(long_enough & (left >= F.col("need")) & (F.size(F.array_intersect("must", "own")) == F.size("must")) & ~F.arrays_overlap("own", "without")).withColumn("common", F.array_intersect("words", "own"))
    first = F.get("common", F.lit(0)) == F.col("word")  # each pair once, from its rarest shared word
    return near.where(first & (F.size("common") >= F.col("need"))).select("id", "label", F.size("common").alias("shared"), "size")


def scan(docs: DataFrame, key: str = "doc_id", templates: list[Template] = TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is the largest share of a template's words held by a block that meets the threshold,
    1 where a base phrase stands, else 0.
    """
    rows = saved(outlines(docs, templates, key), "license-outlines")
    hits = template_hits(rows, templates).groupBy("id").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))
    base = rows.drop("held", "spans", "w")
    return base.join(saved(hits, "license-hits"), "id", "left").select(
        key, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
_phrase_rows = ", ".join(f"('{label}', string_split('{p}', ' '))" for label, p in PHRASES.items())
_template_rows = ", ".join(f"({i}, '{t.label}', {_list(t.words)}, {_list(t.must)}, {_list(t.without)}, {t.span})" for i, t in enumerate(TEMPLATES))
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
phrases AS (SELECT * FROM (VALUES {_phrase_rows}) AS v(label, p)),
templates AS (SELECT * FROM (VALUES {_template_rows}) AS v(id, label, words, must, without, span)),
places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, label, w, p, unnest(range(0, len(w) - len(p) + 1)) AS i FROM d, phrases WHERE len(w) >= len(p))
  WHERE w[i + 1:i + len(p)] = p
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
),
near AS (SELECT doc_id, w, t.* FROM (SELECT doc_id, w, list_distinct(w) AS held FROM d) JOIN templates t ON 100 * len(list_intersect(words, held)) >= {THRESHOLD} * len(words)),
blocks AS (SELECT doc_id, label, words, must, without, w[i + 1:i + 2 * span] AS block FROM (SELECT *, unnest(range(0, len(w), span)) AS i FROM near)),
hits AS (
  SELECT doc_id, label, len(list_intersect(words, list_distinct(block))) / len(words) AS share FROM blocks
  WHERE 100 * len(list_intersect(words, list_distinct(block))) >= {THRESHOLD} * len(words) AND list_has_all(block, must) AND NOT list_has_any(block, without)
),
best AS (SELECT doc_id, max(share) AS score FROM hits GROUP BY doc_id),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
