"""License scan (operator 9), DataFrame functions only.

A text is normalised (lower case, letters and digits, single spaces) to one
sequence of words, so line breaks, comment marks and punctuation inside a notice
do not matter. Each licence template of n words is compared with the windows of n
words of the text (the whole text where it is shorter) by the Dice coefficient of
their sets of word bigrams, 2 |A and B| / (|A| + |B|). Of a template's windows the
one that holds the most of its bigrams counts, the last of equals; it is a match at
``least`` or more. Where matches of a text overlap, the best stays: higher
coefficient, then more words, then the template's name.

Size bounds prune before any bigram is made. A coefficient of t needs
o = t / (2 - t) |B| common bigrams at least, so no set of words that touches more
than |B| - o of them may be missing as a whole: a text without any word of such a
set (long words first) cannot match. One split of the text and its intersection with
all those words decides that for every template. What is left is written once; its bigrams meet the templates' by an equi join, so only
template bigrams are shuffled, grouped by stretches of n places (at most 2n rows a
group). The best window starts at a common bigram or ends the text, so only those
starts are tried.

The templates are a parameter table (license, text) whose words make up the tests;
it is read on the driver. Null and empty texts have no words.
Repeated rows (same id and text) count once, rows of one id with other texts
apart. Empty tables and templates of fewer than two words match nothing. A text of
any length is one array of words; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskgrid.session import scratch_path

# Public licence notices, headers and opening and closing paragraphs of licence bodies.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0 header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0 header, terms", "Unless required by applicable law or agreed to in writing, software distributed under the License "
     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
     "for the specific language governing permissions and limitations under the License."),
    ("MIT grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
     "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met:"),
    ("ISC grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version."),
]


COMMON = 5  # letters of a word that may well be common


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda x: x != "")


def pairs(w: Column) -> Column:
    """The word bigrams in order, repeats included."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def needed(n_bigrams: int, least: float) -> int:
    """Common bigrams that a coefficient of ``least`` takes with a template of ``n_bigrams``."""
    return math.ceil(least / (2 - least) * n_bigrams - 1e-9)


def telling_words(template: list[str], least: float, without: str = "") -> list[str]:
    """Words of which a match holds one at least: long ones that together touch more bigrams than may be missing."""
    grams = set(zip(template, template[1:]))
    out, touched = [], set()
    for w in sorted(set(template) - {without}, key=lambda x: (-len(x), x)):
        out.append(w)
        touched |= {g for g in grams if w in g}
        if len(touched) > len(grams) - needed(len(grams), least):
            return out
    return []


def word_tests(template: list[str], least: float) -> list[list[str]]:
    """Sets of words; a match holds a word of each. A set with short, common words has others beside it without them."""
    first = telling_words(template, least)
    more = [telling_words(template, least, w) for w in first if len(w) <= COMMON]
    return [first, *[x for x in more if x]]


def likely(text: Column, templates_words: list[list[str]], least: float) -> Column:
    """Whether a text passes the word tests of any template."""
    tests = [word_tests(w, least) for w in templates_words]
    asked = sorted({w for t in tests for s in t for w in s})
    if not asked:
        return F.lit(False)
    lits = lambda ws: F.array(*[F.lit(w) for w in ws])
    # a lambda's variable: the text is split once, however many tests ask for its words
    present = F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lits(asked))
    return F.exists(F.array(present), lambda p: reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.arrays_overlap(p, lits(s)) for s in t]) for t in tests]))


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text",
         least: float = 0.8) -> DataFrame:
    """(id, license, start, words, dice): the matches; ``start`` is the window's first word, from 1."""
    spark = df.sparkSession
    t = known.select("license", words(F.col("text")).alias("w")).withColumn("grams", F.array_distinct(pairs(F.col("w"))))
    t = t.filter(F.size("grams") > 0).select("license", F.size("w").alias("n"), "grams", F.size("grams").alias("size_b"), F.ceil(
        F.size("grams") * (least / (2 - least)) - 1e-9).cast("int").alias("need"), "w")
    own = [list(r["w"]) for r in t.select("w").collect()]
    path = scratch_path(spark, "licence-candidates")
    (df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).filter(likely(F.col("text"), own, least)).dropDuplicates(["doc_id", "text"])
       .select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
       .write.parquet(path))
    u = spark.read.parquet(path)

    grams = t.select("license", "n", "need", "size_b", F.explode("grams").alias("gram"))
    hits = (u.select("row", F.size("w").alias("m"), F.posexplode(pairs(F.col("w"))).alias("p", "gram")).join(grams, "gram")
            .select("row", "license", "n", "need", "size_b", (F.col("p") + 1).alias("p"), "gram",
                    F.greatest(F.col("m") - F.col("n") + 1, F.lit(1)).alias("last")))
    # a window of n words lies within two neighbouring stretches of n places
    block = F.floor(F.col("p") / F.col("n")).cast("bigint")
    near = hits.withColumn("block", F.explode(F.array(block, block - 1))).groupBy(
        "row", "license", "n", "need", "size_b", "last", "block").agg(F.collect_list(F.struct("p", "gram")).alias("hits"))
    near = near.filter(F.size("hits") >= F.col("need")).withColumn("starts", F.filter(F.array_distinct(F.transform(
        "hits", lambda h: F.least(h["p"], F.col("last")))), lambda s: F.floor(s / F.col("n")) == F.col("block")))
    tried = F.transform("starts", lambda s: F.struct(F.size(F.array_distinct(F.transform(F.filter(
        "hits", lambda h: (h["p"] >= s) & (h["p"] < s + F.col("n") - 1)), lambda h: h["gram"]))).alias("common"), s.alias("start")))
    best = near.withColumn("best", F.array_max(tried)).filter(F.col("best.common") >= F.col("need")).groupBy(
        "row", "license", "n", "size_b").agg(F.max("best").alias("best"))

    held = F.slice("w", F.col("best.start"), F.col("n"))
    dice = 2 * F.col("best.common") / (F.size(F.array_distinct(pairs(held))) + F.col("size_b"))
    found = u.join(best, "row").select("row", "doc_id", F.struct(
        (-dice).alias("order"), (-F.col("n")).alias("short"), "license", F.col("best.start").alias("start"),
        (F.col("best.start") + F.size(held)).alias("end")).alias("x")).filter(F.col("x.order") <= -least)
    # a text has at most one match of each template
    kept = F.filter("xs", lambda x: ~F.exists("xs", lambda y: (y < x) & (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return found.groupBy("row", "doc_id").agg(F.collect_list("x").alias("xs")).select(
        "doc_id", F.explode(kept).alias("x")).select(
        F.col("doc_id").alias(id_col), "x.license", "x.start", (F.col("x.end") - F.col("x.start")).alias("words"),
        F.round(-F.col("x.order"), 6).alias("dice"))


_VALUES = ", ".join("('" + k + "', '" + re.sub("'", "''", t) + "')" for k, t in TEMPLATES)
SQL = rf"""
WITH t(license, text) AS (VALUES {_VALUES}),
tw AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
b AS (SELECT license, len(w) AS n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw),
d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM d),
g AS (SELECT doc_id, text, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM a),
-- texts that hold two thirds of a template's bigrams somewhere: a coefficient of 0.8 needs them
c AS (SELECT doc_id, text, w, g, license, n, b FROM g JOIN b ON len(list_intersect(g, b)) >= ceil(len(b) * 2 / 3.0 - 1e-9)),
s AS (SELECT *, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) AS start FROM c),
x AS (SELECT doc_id, text, license, n, start, len(b) AS size_b, list_distinct(g[start:start + n - 2]) AS a, b, len(w) AS m FROM s),
y AS (SELECT *, len(list_intersect(a, b)) AS common FROM x
      QUALIFY row_number() OVER (PARTITION BY doc_id, text, license ORDER BY len(list_intersect(a, b)) DESC, start DESC) = 1),
z AS (SELECT doc_id, text, license, n, start, least(n, m) AS words, 2.0::DOUBLE * common / (len(a) + size_b) AS dice FROM y)
SELECT doc_id, license, CAST(start AS INTEGER) AS start, CAST(words AS INTEGER) AS words, round(dice, 6) AS dice FROM z
WHERE dice >= 0.8 AND NOT EXISTS (SELECT 1 FROM z o WHERE o.doc_id IS NOT DISTINCT FROM z.doc_id AND o.text = z.text
  AND o.dice >= 0.8 AND o.start < z.start + z.words AND z.start < o.start + o.words AND (o.dice > z.dice
  OR o.dice = z.dice AND (o.n > z.n OR o.n = z.n AND o.license < z.license)))"""
