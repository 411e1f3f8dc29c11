"""Licence notices in texts: Dice coefficient over word bigrams (DataFrame functions only).

A text is normalised to lower-case words. For every template, windows of the template's number of words slide over the
whole text, across lines and paragraphs, over all places where some bigram lies as far from the window's start as from the
template's; a window matches where the Dice coefficient of its set of bigrams and the template's reaches
``MIN_PERCENT``. Of matching windows that overlap the best is reported: most shared bigrams, then the
highest coefficient, the first place, and the first name.

Plan
----
1. *Size bounds.* A window that reaches the coefficient shares at least ``need`` of the template's ``b`` bigrams, which
   follows from the sizes alone. So it holds one of any ``b - need + 1`` of them: the template's anchors, those with most
   letters, which ordinary prose hardly has. One scan keeps the texts with an anchor, by hashes of their bigrams.
2. Only these texts go on, with a number that is written, and only with the templates whose anchors they have. Their
   bigrams meet all of the template's; each hit puts the template at a place, and windows are compared there.

Defined results
---------------
* Null and empty texts, and texts of one word, have no matches; a text shorter than a template is one window. An empty
  table gives an empty table. Only key and text are read, whatever the other columns are called.
* Rows are judged one by one: repeated rows, and rows of one id, give their matches each. Texts of any length are
  compared whole; a text's words are one array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm import common

#: The least coefficient, in percent.
MIN_PERCENT = 80
#: Rows with an anchor up to this number (some 20 MB) are told to all tasks; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 300_000

# Wording of common licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause/line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause/line": "Licensed under the BSD 3-Clause License.",
    "bsd/notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0/line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0/line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0/line": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0/line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0/line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc/notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit/line": "Released under the MIT License.",
    "mit/notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "bsd-2-clause/conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause/endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd/disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc/disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit/disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense/terms": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib/notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def normalise(text: Column) -> Column:
    """Lower case, with runs of anything but letters and digits turned into one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _plain(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _each(words: Column, f) -> Column:
    """``f`` of every two neighbours of an array of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), f)


def _joined(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def templates(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    """Rows (template, len, w, t): number of words, words, and distinct bigrams of the templates, a fixed number of rows."""
    listed = [F.struct(F.lit(k).alias("template"), F.lit(" ".join(_plain(v))).alias("text")) for k, v in sorted(named.items())]
    rows = spark.range(1, numPartitions=1).select(F.inline(F.array(*listed))).select("template", F.split("text", " ").alias("w"))
    return rows.select("template", F.size("w").alias("len"), "w", F.array_distinct(_each(F.col("w"), _joined)).alias("t")).where("len > 1")


def needed(bigrams: Column, percent: int) -> Column:
    """The least number of shared bigrams, from 200 shared >= percent (window + template) and window >= shared."""
    return F.ceil(percent * bigrams / F.lit(200 - percent))


def anchors(listed: DataFrame, percent: int) -> DataFrame:
    """Rows (h, template): hashes of bigrams of which every matching window has one, those with most letters."""
    pairs = F.array_sort(F.array_distinct(_each(F.col("w"), lambda a, b: F.struct((-F.length(a) - F.length(b)).alias("less"), a.alias("a"), b.alias("b")))))
    some = F.slice(pairs, 1, (F.size(pairs) - needed(F.size(pairs), percent) + 1).cast("int"))
    return listed.select("template", F.explode(some).alias("p")).select(F.xxhash64("p.a", "p.b").alias("h"), "template")


def scan(docs: DataFrame, *, named: dict[str, str] | None = None, percent: int = MIN_PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, first_word, last_word, license, dice, n_shared, n_bigrams) of the windows that match; words count from 0."""
    spark = docs.sparkSession
    listed = templates(spark, named or TEMPLATES)
    hashes = _each(F.col("w"), lambda a, b: F.xxhash64(a, b))
    met_by = anchors(listed, percent)
    any_of = [r["h"] for r in met_by.select("h").distinct().collect()]  # some per template
    words = F.split(normalise(F.col(f"`{text}`").cast("string")), " ")
    # a generator makes the words once; a plain column would be worked out for every condition on it
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.inline(F.array(F.struct(words.alias("w"))))).where(F.size("w") > 1)
    # rows are numbered as they are written, and the numbers are read
    few = rows.where(F.exists(hashes, lambda h: h.isin(any_of))).withColumn("row", F.monotonically_increasing_id())
    few, _ = common.written(few, "texts")
    met = few.select("row", F.explode(hashes).alias("h")).join(F.broadcast(met_by), "h").select("row", "template").distinct()
    met, _ = common.written(met, "met")
    near = F.broadcast if met.count() <= MAX_BROADCAST_ROWS else lambda d: d

    every = listed.select("template", "len", F.posexplode(hashes).alias("place", "h"))
    hits = few.select("row", F.size("w").alias("n"), F.posexplode(hashes).alias("pos", "h")).join(F.broadcast(every), "h")
    hits = hits.join(near(met), ["row", "template"], "left_semi")
    start = F.greatest(F.least(F.col("pos") - F.col("place"), F.col("n") - F.col("len")), F.lit(0))
    places = hits.groupBy("row", "template").agg(F.collect_set(start).alias("starts"))

    def compared(s: Column) -> Column:
        own = F.array_distinct(_each(F.slice("w", s + 1, F.col("len")), _joined))
        return F.struct(s.alias("first_word"), F.size(F.array_intersect(own, "t")).alias("n_shared"), F.size(own).alias("n_bigrams"))

    found = places.join(few, "row").join(F.broadcast(listed.drop("w")), "template")
    found = found.select("row", "key", "template", "len", F.size("t").alias("b"), F.size("w").alias("n"), F.inline(F.transform("starts", compared)))
    found = found.where(200 * F.col("n_shared") >= percent * (F.col("n_bigrams") + F.col("b")))
    found = found.withColumn("last_word", F.least(F.col("first_word") + F.col("len"), F.col("n")) - 1)
    found = found.withColumn("dice", 2.0 * F.col("n_shared") / (F.col("n_bigrams") + F.col("b")))
    best = _best_of_overlapping(_best_of_overlapping(found, "row", "template"), "row")
    return best.select(F.col("key").alias(key), "first_word", "last_word", F.col("template").alias("license"), "dice", "n_shared", "n_bigrams")


def _best_of_overlapping(found: DataFrame, *group: str) -> DataFrame:
    """Of every chain of overlapping windows of a group the best."""
    order = Window.partitionBy(*group).orderBy("first_word", "last_word", "template")
    before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = found.withColumn("opens", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
    chained = chained.withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*group, "chain").orderBy(F.desc("n_shared"), F.desc("dice"), "first_word", "template")
    return chained.withColumn("place", F.row_number().over(best)).where("place = 1").drop("opens", "chain", "place")


def oracle_sql(named: dict[str, str] | None = None, percent: int = MIN_PERCENT) -> str:
    """DuckDB SQL of ``scan`` over the table ``documents``: every hit of any bigram of a template, with no anchors."""
    values = ", ".join("('{}', '{}')".format(k, " ".join(w)) for k, w in ((k, _plain(v)) for k, v in sorted((named or TEMPLATES).items())) if len(w) > 1)
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    best = """SELECT * EXCLUDE (opens, chain) FROM (SELECT *, sum(opens) OVER (PARTITION BY {0} ORDER BY first_word, last_word, template ROWS UNBOUNDED PRECEDING) AS chain FROM (
    SELECT *, CASE WHEN first_word <= max(last_word) OVER (PARTITION BY {0} ORDER BY first_word, last_word, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {1}))
  QUALIFY row_number() OVER (PARTITION BY {0}, chain ORDER BY n_shared DESC, dice DESC, first_word, template) = 1"""
    return f"""
WITH t AS (
  SELECT template, tw, {pairs.format("tw")} AS t FROM (SELECT template, string_split(words, ' ') AS tw FROM (VALUES {values}) v(template, words))
), places AS (
  SELECT template, len(tw) AS len, t, unnest(range(0, len(tw) - 1)) AS place, unnest(list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1])) AS g FROM t
), d AS (
  SELECT doc_id, w FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 1
), bigrams AS (
  SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, len(w) AS n FROM d
), starts AS (
  SELECT DISTINCT doc_id, template, greatest(least(pos - place, n - len), 0) AS first_word FROM bigrams JOIN places USING (g)
), windows AS (
  SELECT doc_id, template, first_word, least(first_word + len(tw), len(w)) - 1 AS last_word, t, w[first_word + 1 : first_word + len(tw)] AS x FROM starts JOIN d USING (doc_id) JOIN t USING (template)
), compared AS (
  SELECT doc_id, template, first_word, last_word, len(t) AS b, len({pairs.format("x")}) AS n_bigrams, len(list_intersect({pairs.format("x")}, t)) AS n_shared FROM windows
), found AS (
  SELECT *, 2.0::DOUBLE * n_shared / (n_bigrams + b) AS dice FROM compared WHERE 200 * n_shared >= {percent} * (n_bigrams + b)
), own AS (
  {best.format("doc_id, template", "found")}
), overall AS (
  {best.format("doc_id", "own")}
)
SELECT doc_id, CAST(first_word AS INTEGER) AS first_word, CAST(last_word AS INTEGER) AS last_word, template AS license, dice, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_bigrams AS INTEGER) AS n_bigrams FROM overall
"""
