"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along directories.

DataFrame functions only. Every line of a text is a possible header, and the
whole text a possible licence file. Weights are fitted on the templates; words
outside of them count in a text's norm as words that no template has. A file
without a header of its own takes the licence of the nearest ancestor directory
that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspan.llm._scratch import unused, written

THRESHOLD = 0.6
TERMS = 20_000  # most terms of all templates together; they are part of the scan's expression

#: Wording of licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
GNU_FILE = "GNU {0}GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Fixed values: (licence, kind, wording). A text matches as a whole or in a block, a header in a block, an opening at a licence file's start.
BLOCKS = [
    ("MIT", "text", f"MIT License Copyright (c) {GRANT} {AS_IS}"),
    ("ISC", "text", ISC),
    ("BSD-2-Clause", "text", BSD + BSD_AS_IS),
    ("BSD-3-Clause", "text", BSD + THIRD + BSD_AS_IS),
    ("Unlicense", "text", UNLICENSE + AS_IS),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((n, "header", GNU.format(name, v)) for n, name, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
    *((n, "opening", GNU_FILE.format(*x)) for n, x in (("GPL-2.0", ("", "2, June 1991", "1989, 1991")), ("GPL-3.0", ("", "3, 29 June 2007", "2007")), ("LGPL-2.1", ("LESSER ", "2.1, February 1999", "1991, 1999")), ("LGPL-3.0", ("LESSER ", "3, 29 June 2007", "2007")), ("AGPL-3.0", ("AFFERO ", "3, 19 November 2007", "2007")))),
    ("Apache-2.0", "opening", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("MPL-2.0", "opening", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    *((n, "notice", t) for n, t in TEMPLATES),
]
#: Least cosine of a short notice within a line or over a line's end, where few words must tell.
SURE = 0.8
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)"


def _terms(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def weights(templates: DataFrame) -> DataFrame:
    """(licence, term, idf, w, unknown): unit TF-IDF vectors; unknown is the weight of terms that no template has."""
    tf = templates.where("licence is not null").select("licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    n = templates.where("licence is not null").agg(F.count_distinct("licence").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    full = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumns({"idf": F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, "unknown": F.log(1 + F.col("n")) + 1})
    norm = full.groupBy("licence").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("norm"))
    return full.join(norm, "licence").select("licence", "term", "idf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w"), "unknown")


def _near(terms: Column, vectors: list[list[tuple[str, float]]], threshold: float) -> Column:
    """True if the terms hold so much of a template that a cosine of ``threshold`` is possible.

    A text's cosine to a unit vector is at most the length of the vector's part
    on terms that the text has. The terms' expression is evaluated once.
    """
    weighed = F.array(*(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w * w).alias("w")) for t, w in v)) for v in vectors))
    every = F.array(*map(F.lit, sorted({t for v in vectors for t, _ in v})))
    length = lambda own, v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.when(F.array_contains(own, x["t"]), x["w"]).otherwise(0.0))
    some = F.transform(F.array(F.array_intersect(terms, every)), lambda own: F.exists(weighed, lambda v: length(own, v) >= threshold * threshold - 1e-9))
    return F.coalesce(F.get(some, F.lit(0)), F.lit(False))


def _reachable(terms: Column, idf: dict[str, float], vectors: list[list[tuple[str, float]]], unknown: float, threshold: float) -> Column:
    """True if the cosine to a template can reach ``threshold``: the product is exact, the text's length a lower bound.

    Terms that no template has count with their weight's square each, which
    repeated ones exceed. Arrays are bound once and then gone through.
    """
    names = sorted(idf)
    every = F.array(*map(F.lit, names))
    weights = F.array(*(F.array(*(F.lit(float(dict(v).get(t, 0.0))) for t in names)) for v in vectors))
    factors = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(idf[t]).alias("i")) for t in names))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def held(own: Column) -> Column:
        counts = F.transform(factors, lambda f: (F.size(own["v"]) - F.size(F.array_remove(own["v"], f["t"]))) * f["i"])
        return F.struct(counts.alias("x"), ((own["n"] - F.size(own["v"])) * (unknown * unknown)).alias("rest"))

    def close(own: Column) -> Column:
        least = F.sqrt(total(F.transform(own["x"], lambda x: x * x)) + own["rest"])
        return F.exists(weights, lambda w: total(F.zip_with(own["x"], w, lambda a, b: a * b)) >= threshold * least - 1e-9)

    split = F.transform(F.array(terms), lambda t: F.struct(F.filter(t, lambda x: F.array_contains(every, x)).alias("v"), F.size(t).alias("n")))
    return F.coalesce(F.get(F.transform(F.transform(split, held), close), F.lit(0)), F.lit(False))


def _bags(blocks: list[tuple[str, str, str]]) -> tuple[list[dict[str, float]], dict[str, float], float, list[int]]:
    """Unit vectors of each block's distinct terms, their idf, the weight of other terms, and the blocks' lengths in terms."""
    terms = [re.findall(r"[^\W_]+", t.lower()) for _, _, t in blocks]
    df = Counter(t for own in terms for t in set(own))
    idf = {t: math.log((1 + len(blocks)) / (1 + n)) + 1 for t, n in df.items()}
    norm = [math.sqrt(sum(idf[t] ** 2 for t in set(own))) for own in terms]
    return [{t: idf[t] / z for t in sorted(set(own))} for own, z in zip(terms, norm, strict=True)], idf, math.log(1 + len(blocks)) + 1, [len(own) for own in terms]


def block_scores(texts: DataFrame, threshold: float, blocks: list[tuple[str, str, str]] = BLOCKS) -> DataFrame:
    """(d, licence, line, whole) of texts (d, t): overlapping blocks of as many terms as a template has, whole texts, SPDX lines.

    Repeated terms of a block count once. A block runs over line ends, so that
    wrapped headers and notices with words after them are found; the next one
    starts a quarter further on.
    """
    if not blocks:
        return texts.select("d", F.lit("").alias("licence"), F.lit(0.0).alias("line"), F.lit(0.0).alias("whole")).limit(0)
    spark = texts.sparkSession
    vectors, idf, unknown, sizes = _bags(blocks)
    weight = F.broadcast(spark.createDataFrame([(i, t, w) for i, v in enumerate(vectors) for t, w in v.items()], "b int, term string, w double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    kinds = F.broadcast(spark.createDataFrame([(i, n, k, size, max(1, size // 4)) for i, ((n, k, _), size) in enumerate(zip(blocks, sizes, strict=True))], "b int, licence string, kind string, size int, step int"))
    # templates of which the text holds enough for a cosine of the threshold
    split = texts.select("d", _terms(F.col("t")).alias("all"))
    held = split.select("d", F.explode(F.array_distinct("all")).alias("term")).join(weight, "term").groupBy("d", "b").agg(F.sum(F.col("w") * F.col("w")).alias("held"))
    asked = held.where(F.col("held") >= threshold * threshold - 1e-9).join(kinds, "b").join(split, "d")
    starts = F.when(F.col("kind") == "opening", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.col("step")))
    cut = F.transform(starts, lambda i: F.struct((i + 1).alias("no"), F.array_distinct(F.slice("all", i + 1, F.col("size"))).alias("own")))
    whole = F.when(F.col("kind") == "text", F.array(F.struct(F.lit(0).alias("no"), F.array_distinct("all").alias("own")))).otherwise(F.array().cast("array<struct<no:int,own:array<string>>>"))
    parts = asked.select("d", "b", "licence", "kind", F.explode(F.concat(whole, cut)).alias("p")).select("d", "b", "licence", "kind", "p.no", F.explode("p.own").alias("term"))
    scored = parts.join(known, "term", "left").join(weight, ["b", "term"], "left").groupBy("d", "b", "licence", "kind", "no").agg((F.sum(F.coalesce("idf", F.lit(unknown)) * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(F.pow(F.coalesce("idf", F.lit(unknown)), F.lit(2))))).alias("score"))
    scored = scored.where(F.col("score") >= F.when(F.col("kind") == "notice", F.lit(max(SURE, threshold))).otherwise(threshold))
    file = (F.col("no") == 0) | (F.col("kind") == "opening")
    found = scored.select("d", "licence", F.when(~file, F.col("score")).alias("line"), F.when(file, F.col("score")).alias("whole"))
    named = texts.select("d", F.explode(F.regexp_extract_all("t", F.lit(SPDX), F.lit(1))).alias("licence")).select("d", "licence", F.lit(1.0).alias("line"), F.lit(None).cast("double").alias("whole"))
    return found.unionByName(named).groupBy("d", "licence").agg(F.round(F.max("line"), 6).alias("line"), F.round(F.max("whole"), 6).alias("whole"))


def scan(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, blocks: list[tuple[str, str, str]] = BLOCKS) -> DataFrame:
    """``files`` with licence, origin, licence_score and licence_path; columns of those names are replaced.

    origin is ``header`` (a line or block reaches the threshold), ``file`` (the whole
    text or its opening does, and governs its directory and all below it), ``inherited`` (from
    the licence file in licence_path) or null. Of several headers the one with
    the highest score counts, ties by licence name; of several licence files in
    a directory the same, then the smallest path. Null and empty texts have no
    own licence, null paths inherit nothing; rows that repeat a path and text
    are judged alike. The score is rounded to six places.
    """
    base = files.drop("licence", "origin", "licence_score", "licence_path")
    weight = written(weights(templates), "weights")
    listed = weight.select("licence", "term", "idf", "w", "unknown").orderBy("licence", "term").limit(TERMS + 1).collect()
    if len(listed) > TERMS:
        raise ValueError(f"templates have over {TERMS} terms")
    vectors = [[(r["term"], r["w"]) for r in listed if r["licence"] == n] for n in sorted({r["licence"] for r in listed})]
    path, text = F.col(path_col), F.col(text_col)
    near = lambda part: _near(_terms(part), vectors, threshold) if vectors else F.lit(False)
    # the whole text is part 0, its lines follow; no row moves before both filters have left little
    least = [max(SURE, threshold) if kind == "notice" else threshold for _, kind, _ in blocks]
    blocked = [[(t, w * threshold / x) for t, w in v.items()] for v, x in zip(_bags(blocks)[0], least, strict=True)]
    reach = lambda t, v: _near(t, v, threshold).cast("int") if v else F.lit(0)
    flags = F.get(F.transform(F.array(_terms(text)), lambda t: reach(t, vectors) + 2 * reach(t, blocked)), F.lit(0)) + F.when(text.contains("SPDX-License-Identifier:"), 4).otherwise(0)
    some = written(base.where(text.isNotNull()).select(text.alias("t"), flags.alias("flags")).where(F.col("flags") > 0), "some")
    parts = some.where(F.col("flags") % 2 == 1).select(F.sha2("t", 256).alias("d"), F.posexplode(F.concat(F.array("t"), F.split("t", "\n"))).alias("no", "part")).where(near(F.col("part")))
    if listed:
        parts = parts.where(_reachable(_terms(F.col("part")), {r["term"]: r["idf"] for r in listed}, vectors, listed[0]["unknown"], threshold))
    parts = written(parts.dropDuplicates(["d", "no"]), "parts")
    tf = parts.select("d", "no", F.explode(_terms(F.col("part"))).alias("term")).groupBy("d", "no", "term").agg(F.count("*").alias("tf"))
    idf = weight.select("term", "idf").distinct()
    unknown = weight.agg(F.max("unknown").alias("unknown"))
    weighed = tf.join(idf, "term", "left").crossJoin(F.broadcast(unknown)).withColumn("x", F.col("tf") * F.coalesce("idf", "unknown"))
    norm = weighed.groupBy("d", "no").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = weighed.where("idf is not null").join(weight.select("licence", "term", "w"), "term").groupBy("d", "no", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    close = dot.join(norm, ["d", "no"]).withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= threshold)
    close = close.groupBy("d", "licence").agg(F.round(F.max(F.when(F.col("no") > 0, F.col("score"))), 6).alias("line"), F.round(F.max(F.when(F.col("no") == 0, F.col("score"))), 6).alias("whole"))
    texts = some.where(F.col("flags") > 1).select(F.sha2("t", 256).alias("d"), "t").dropDuplicates(["d"])
    close = close.unionByName(block_scores(texts, threshold, blocks)).groupBy("d", "licence").agg(F.max("line").alias("line"), F.max("whole").alias("whole"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), F.col("licence").alias("l"))))
    own = written(close.groupBy("d").agg(best("whole").alias("whole"), best("line").alias("line")), "own")

    digest, folder, whole, line, g = (unused(base.columns, n) for n in ("__digest", "__folder", "__whole", "__line", "__governing"))
    rows = base.withColumn(digest, F.sha2(text, 256)).withColumn(folder, F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    judged = rows.join(own.select(F.col("d").alias(digest), F.col("whole").alias(whole), F.col("line").alias(line)), digest, "left")
    own_licence = F.coalesce(whole, line)
    # licence files by directory, and for each directory the nearest one above
    governed = judged.where(F.col(whole).isNotNull() & path.isNotNull()).groupBy(F.col(folder).alias("dir")).agg(F.min(F.struct(f"{whole}.s", f"{whole}.l", path.alias("p"))).alias("g"))
    dirs = rows.where(path.isNotNull()).select(F.col(folder).alias("d")).distinct()
    steps = F.split("d", "/")
    above = dirs.select("d", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("dir")))).alias("a")).select("d", "a.depth", "a.dir")
    nearest = above.join(governed, "dir").groupBy(F.col("d").alias(folder)).agg(F.max_by("g", "depth").alias(g))
    out = judged.join(nearest, folder, "left").withColumn(g, F.when(path.isNotNull() & own_licence.isNull(), F.col(g)))
    return out.select(
        *base.columns,
        F.coalesce(own_licence["l"], F.col(f"{g}.l")).alias("licence"),
        F.when(F.col(whole).isNotNull(), "file").when(F.col(line).isNotNull(), "header").when(F.col(g).isNotNull(), "inherited").alias("origin"),
        (-F.coalesce(own_licence["s"], F.col(f"{g}.s"))).alias("licence_score"),
        F.when(own_licence.isNotNull(), path).otherwise(F.col(f"{g}.p")).alias("licence_path"),
    )


def oracle(files: str) -> str:
    """DuckDB SQL for ``scan`` over the rows (doc_id, path, text) of the query ``files``."""
    values = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = "unnest(regexp_extract_all(" + lower + r", '[\p{{L}}\p{{N}}]+'))"
    return rf"""
WITH t(licence, text) AS (VALUES {values}), f AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM ({files}) z),
tt AS (SELECT licence, term, count(*) AS tf FROM (SELECT licence, {terms.format("text")} AS term FROM t) z GROUP BY 1, 2),
td AS (SELECT term, ln({len(TEMPLATES) + 1}.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM tt GROUP BY 1),
tn AS (SELECT licence, sqrt(sum((tf * idf) ** 2)) AS norm FROM tt JOIN td USING (term) GROUP BY 1),
w AS (SELECT licence, term, tf * idf / norm AS w FROM tt JOIN td USING (term) JOIN tn USING (licence)),
s AS (SELECT i, generate_subscripts(l, 1) AS no, unnest(l) AS part FROM (SELECT i, string_split(text, chr(10)) AS l FROM f) z UNION ALL SELECT i, -1, text FROM f),
k AS (SELECT i, no, part FROM s WHERE regexp_matches({lower.format("part")}, '{"|".join(sorted({w for _, t in TEMPLATES for w in t.lower().replace(",", " ").replace(".", " ").replace("-", " ").replace("/", " ").replace(":", " ").split() if w.startswith("licen") or w in ("cc", "mit", "mozilla", "redistribution", "permission", "unencumbered", "apache", "gnu", "creative", "software", "binary", "granted")}))}')),
x AS (SELECT i, no, term, count(*) AS tf FROM (SELECT i, no, {terms.format("part")} AS term FROM k) z GROUP BY ALL),
y AS (SELECT i, no, term, tf * coalesce(idf, ln({len(TEMPLATES) + 1}.0::DOUBLE) + 1) AS x FROM x LEFT JOIN td USING (term)),
n AS (SELECT i, no, sqrt(sum(x * x)) AS norm FROM y GROUP BY ALL),
c AS (SELECT i, no, licence, sum(x * w) / any_value(norm) AS score FROM y JOIN w USING (term) JOIN n USING (i, no) GROUP BY ALL HAVING sum(x * w) / any_value(norm) >= {THRESHOLD}),
b AS (SELECT i, licence, round(max(score) FILTER (no > 0), 6) AS line, round(max(score) FILTER (no < 0), 6) AS whole FROM c GROUP BY ALL),
o AS (SELECT i, min({{'s': -whole, 'l': licence}}) FILTER (whole IS NOT NULL) AS whole, min({{'s': -line, 'l': licence}}) FILTER (line IS NOT NULL) AS line FROM b GROUP BY i),
d AS (SELECT f.*, whole, line, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f LEFT JOIN o USING (i)),
g AS (SELECT dir, min({{'s': whole.s, 'l': whole.l, 'p': path}}) AS g FROM d WHERE whole IS NOT NULL AND path IS NOT NULL GROUP BY dir),
h AS (SELECT d.i, arg_max(g, length(g.dir)) AS g FROM d JOIN g ON d.dir = g.dir OR starts_with(d.dir, g.dir || '/') WHERE whole IS NULL AND line IS NULL GROUP BY d.i)
SELECT doc_id, path, coalesce(whole.l, line.l, g.l) AS licence, CASE WHEN whole IS NOT NULL THEN 'file' WHEN line IS NOT NULL THEN 'header' WHEN g IS NOT NULL THEN 'inherited' END AS origin,
  -coalesce(whole.s, line.s, g.s) AS licence_score, CASE WHEN whole IS NOT NULL OR line IS NOT NULL THEN path ELSE g.p END AS licence_path
FROM d LEFT JOIN h USING (i)
"""
