"""Licence scans: sparse TF-IDF cosines to templates, then inheritance from the nearest directory.

Units are the lines and sentences of a text, windows of ``WINDOW`` of them (headers and notices that are
wrapped) and the whole text (licence files).  Terms are weighted by their frequency in the unit and by
how rare they are among the templates; a unit's licence is the template of the largest cosine, if that
reaches ``COSINE``.  Templates are the wordings, tags, standard headers and texts under which licences are
published.  A file whose whole text matches, or whose name says that it is a licence file and one of
whose units matches, licenses its directory, and files without a licence of their own inherit from the
nearest ancestor that has one.

Only DataFrame operations are used.  Units that hold none of the templates' anchor terms are left
out early; by the Cauchy-Schwarz inequality no such unit can reach ``COSINE`` (see :func:`anchors`).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, stored

COSINE = 0.7
#: SPDX identifiers and names of licences.
NAMES = {
    "0BSD": "the Zero-Clause BSD License",
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "BSL-1.0": "the Boost Software License, Version 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
    "EPL-2.0": "the Eclipse Public License, version 2.0",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "ISC": "the ISC License",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, version 2.0",
    "Unlicense": "the Unlicense",
    "Zlib": "the zlib License",
}
#: Identifiers of the licences that name whether later versions may be used.
VERSIONED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
#: Wordings by which works are put under a licence; the last is a name alone, as in the title of a licence file.
WORDINGS = (
    "Licensed under {}",
    "Released under {}",
    "This work is licensed under {}",
    "This program is distributed under the terms of {}",
    "This file is available under the terms of {}",
    "{}",
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under the Creative Commons {} 4.0 International License."
_CC_VIEW = "To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_LIST = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy"
_MIT_REST = ' of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_END = ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_FREE = "This is free and unencumbered software released into the public domain."
_FREE_REST = " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
#: Standard headers, and openings and texts of licences, in the words in which they are published.
TEXTS = {
    "0BSD": [_ISC + ". " + _AS_IS],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.format("Affero ", 3)],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification", _BSD, _BSD + _BSD_LIST, _BSD + _BSD_LIST + _BSD_END],
    "BSD-3-Clause": [_BSD_NAMES, _BSD + _BSD_LIST + " 3. " + _BSD_NAMES, _BSD + _BSD_LIST + " 3. " + _BSD_NAMES + _BSD_END],
    "BSL-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "CC-BY-4.0": [_CC.format("Attribution"), _CC_VIEW.format("by"), "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": [_CC.format("Attribution-NonCommercial"), _CC_VIEW.format("by-nc"), "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": [_CC.format("Attribution-ShareAlike"), _CC_VIEW.format("by-sa"), "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 2", _GNU.format("", 2)],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 3", _GNU.format("", 3)],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose", _ISC + ".", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", "provided that the above copyright notice and this permission notice appear in all copies.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _GNU.format("Lesser ", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("Lesser ", 3)],
    "MIT": [_MIT, _MIT + " of this software and associated documentation files", _MIT + _MIT_REST, _MIT + _MIT_REST + _MIT_END, "MIT License (MIT)"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": [_FREE, _FREE + _FREE_REST, "For more information, please refer to <http://unlicense.org/>"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}


def _templates() -> dict[str, str]:
    """A template for each licence and wording, tag or text, named licence#number."""
    out = {}
    for licence, name in NAMES.items():
        tags = [licence, *(f"{licence}-{v}" for v in ("only", "or-later") if licence in VERSIONED)]
        words = [w.format(name) for w in WORDINGS] + [f"SPDX-License-Identifier: {tag}" for tag in tags] + TEXTS[licence]
        out |= {f"{licence}#{i}": text for i, text in enumerate(words)}
    return out


TEMPLATES = _templates()
#: A term: letters and digits of ASCII, with full stops inside.
TERM = "[a-z0-9]+(?:[.][a-z0-9]+)*"
#: Words that most texts hold; they are no terms.
COMMON = "a all an and any are as at be but by can do for from has have if in into is it its made may must no not of on one only or other out shall so that the their there this to use used was were which will with you your".split()
#: Lines of a window.
WINDOW = 4
#: Names of licence files.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([-.][^/]*)?$"


def weights(templates: dict[str, str]) -> tuple[dict[str, float], float, list[tuple[str, str, float]]]:
    """The rarity of each term, that of terms in no template, and (term, template, weight) of unit vectors."""
    counts = {name: Counter(t for t in re.findall(TERM, text.lower()) if t not in COMMON) for name, text in templates.items()}
    df = Counter(t for c in counts.values() for t in c)
    rarity = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * rarity[t]) ** 2 for t, n in c.items()))
        rows += [(t, name, n * rarity[t] / norm) for t, n in c.items()]
    return rarity, math.log(1 + len(counts)) + 1, rows


def anchors(rows: list[tuple[str, str, float]], cosine: float) -> list[str]:
    """Terms one of which any unit of that cosine to some template must hold.

    A unit that shares only terms of weights w with a template has a cosine of at most the root of
    their sum of squares.  So the lightest terms of a template, up to that bound, are no anchors.
    """
    out = set()
    for name in {n for _, n, _ in rows}:
        left = 0.0
        for term, w in sorted(((t, w) for t, n, w in rows if n == name), key=lambda x: (x[1], x[0])):
            left += w * w
            if left >= cosine * cosine - 1e-9:
                out.add(term)
    return sorted(out)


def prefix_tree(words: list[str]) -> str:
    """A regular expression for any of ``words`` in which those with the same beginning share it."""
    below: dict[str, list[str]] = {}
    for word in words:
        below.setdefault(word[:1], []).append(word[1:])
    parts = [re.escape(c) + prefix_tree(rest) for c, rest in sorted(below.items()) if c]
    return ("(?:" + "|".join(parts) + ")" if parts else "") + ("?" if parts and "" in below else "")


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    quoted = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({schema})")


def hopeful(units: DataFrame, templates: dict[str, str], cosine: float) -> DataFrame:
    """The units that may reach ``cosine``, with their ``terms``.

    A cosine is at most the length of the part of a unit that lies in the templates' terms, over the
    length of all of it; and the rest is at least as long as if none of its terms came twice.  The
    first is computed, the second bounded by a count, so nothing is sent to other tasks for this.
    """
    rarity, other, _ = weights(templates)
    terms = units.withColumn("terms", F.filter(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), 0), lambda t: ~t.isin(*COMMON))).drop("unit")
    terms = terms.withColumn("known", F.filter("terms", lambda t: t.isin(*rarity)))
    rare = F.create_map(*(F.lit(x) for pair in rarity.items() for x in pair))
    squares = F.transform(F.array_distinct("known"), lambda v: F.pow(F.size(F.filter("known", lambda t: t == v)) * F.element_at(rare, v), F.lit(2.0)))
    inside = F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)
    outside = (F.size("terms") - F.size("known")) * (other * other)
    may = inside * (1 - cosine * cosine) >= outside * (cosine * cosine) - 1e-9
    return terms.where((F.size("known") > 0) & may).drop("known")


def match_units(units: DataFrame, keys: list[str], templates: dict[str, str], cosine: float) -> DataFrame:
    """keys, licence and score of each of ``units`` (keys, terms array) that matches a template."""
    spark = units.sparkSession
    rarity, other, rows = weights(templates)
    terms = units.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    terms = stored(terms, "licence-terms")
    # The templates are a fixed table of a few hundred rows.
    weighed = terms.join(F.broadcast(_values(spark, list(rarity.items()), "term, rarity")), "term", "left").withColumn("x", F.col("tf") * F.coalesce("rarity", F.lit(other)))
    weighed = weighed.select(*keys, "term", "x")
    length = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = weighed.join(F.broadcast(_values(spark, rows, "term, template, w")), "term").groupBy(*keys, "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scores = dots.join(length, keys).select(*keys, F.substring_index("template", "#", 1).alias("licence"), F.round(F.col("dot") / F.col("length"), 6).alias("score")).where(F.col("score") >= cosine)
    # Of the largest score, the licence that comes last.
    best = scores.groupBy(*keys).agg(F.max("score").alias("score"), F.collect_list(F.struct("score", "licence")).alias("all"))
    return best.select(*keys, F.array_max(F.transform(F.filter("all", lambda s: s["score"] == F.col("score")), lambda s: s["licence"])).alias("licence"), "score")


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end; empty for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def sentences(column: str) -> Column:
    """The lines of a text, cut after punctuation that a blank follows."""
    return F.split(F.regexp_replace(column, "([.;!?])[ \t]+", "$1\n"), "\n")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """Licences of ``files`` (doc_id long, path string, text string), a row per row.

    Returns doc_id, path, licence, score (of the match it comes from), origin: "header" (a line, sentence
    or window of the file), "file" (its whole text), "inherited" or null, and from_path (the file it comes
    from).

    Of several matches of a file the whole text counts before its parts, then the largest score, then the
    licence that comes last by name; of several licence files of a directory, the same and then the
    least path.  Null and empty texts match nothing but may inherit; a null path counts as empty, in the
    root.  Texts of any length are read whole.  Rows with equal path and text get equal results; columns
    besides the three are ignored.  An empty table gives an empty result.
    """
    _, _, rows = weights(templates)
    held = r"(?i)(?<![a-z0-9.])" + prefix_tree(anchors(rows, cosine)) + r"(?![a-z0-9])"
    docs = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), body().alias("text")).withColumn("key", F.xxhash64("text"))
    likely = docs.where(F.col("text").rlike(held)).withColumn("lines", sentences("text"))
    numbered = lambda many, at: F.transform(many, lambda x, i: F.struct((i * 2 + at).alias("line"), x.alias("unit")))
    windows = F.transform("lines", lambda x, i: F.array_join(F.slice("lines", i + 1, WINDOW), " "))
    parts = F.filter(F.concat(numbered(F.col("lines"), 1), numbered(windows, 2)), lambda s: s["unit"].rlike(held))
    whole = F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"))
    units = likely.select("path", "key", F.explode(F.concat(F.array(whole), parts)).alias("u")).select("path", "key", "u.line", "u.unit")
    matched = stored(match_units(hopeful(units, templates, cosine), ["path", "key", "line"], templates, cosine), "licence-lines")
    last = F.struct((F.col("line") == 0).alias("is_whole"), "score", "licence")
    own = matched.groupBy("path", "key").agg(F.max(last).alias("m")).select("path", "key", "m.licence", "m.score", F.when(F.col("m.is_whole"), "file").otherwise("header").alias("origin"))
    own = stored(own, "licences")

    licensing = own.where((F.col("origin") == "file") | F.col("path").rlike(LICENCE_FILE)).withColumn("dir", directory(F.col("path")))
    given = licensing.groupBy("dir").agg(F.max(F.struct((F.col("origin") == "file").alias("is_whole"), "score", "licence")).alias("g"))
    given = given.select(F.col("dir").alias("above"), "g.*")
    chosen = licensing.join(given, (F.col("dir") == F.col("above")) & (F.col("is_whole") == (F.col("origin") == "file")) & (licensing["score"] == given["score"]) & (licensing["licence"] == given["licence"]))
    given = stored(chosen.groupBy("above").agg(F.max(given["licence"]).alias("g_licence"), F.max(given["score"]).alias("g_score"), F.min("path").alias("g_path")), "licensed-dirs")

    # Each directory once, with itself and its ancestors; the deepest that is licensed is the nearest.
    names = F.split("dir", "/")
    dirs = docs.select(directory(F.col("path")).alias("dir")).distinct()
    upward = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(names))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(names, F.lit(1), n), "/").alias("above")))
    near = dirs.select("dir", F.explode(upward).alias("a")).select("dir", "a.depth", "a.above").join(given, "above")
    near = near.groupBy("dir").agg(F.max(F.struct("depth", "g_licence", "g_score", "g_path")).alias("n")).select("dir", "n.g_licence", "n.g_score", "n.g_path")
    near = stored(near, "dir-licences")

    rows = docs.select("doc_id", "path", "key", directory(F.col("path")).alias("dir")).join(own, ["path", "key"], "left").join(near, "dir", "left")
    return rows.select(
        "doc_id",
        "path",
        F.coalesce("licence", "g_licence").alias("licence"),
        F.coalesce("score", "g_score").alias("score"),
        F.coalesce("origin", F.when(F.col("g_licence").isNotNull(), "inherited")).alias("origin"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("g_path")).alias("from_path"),
    )


def document_path() -> Column:
    """Paths for the rows of ``documents``, which have none, from their columns.

    Of every eight rows by number one is the licence file of its directory, source/(doc_id div 200), one
    that of a directory below it, for its language, and the others are texts there.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    number, kind = F.col("doc_id"), F.pmod("doc_id", F.lit(8))
    above = F.concat(part(F.col("source")), F.lit("/"), part(F.floor(number / 200).cast("long")))
    below = F.concat(above, F.lit("/"), part(F.col("lang")))
    return (
        F.when(kind == 0, F.concat(above, F.lit("/LICENSE-"), part(number), F.lit(".txt")))
        .when(kind == 4, F.concat(below, F.lit("/LICENSE-"), part(number), F.lit(".txt")))
        .otherwise(F.concat(below, F.lit("/"), part(number), F.lit(".txt")))
    )


def oracle_sql(templates: dict[str, str] = TEMPLATES, cosine: float = COSINE) -> str:
    """DuckDB SQL for the scan of ``documents``, without the early filter."""
    rarity, other, rows = weights(templates)
    terms = ", ".join(f"('{t}', {r!r}::DOUBLE)" for t, r in rarity.items())
    vectors = ", ".join(f"('{t}', '{n}', {w!r}::DOUBLE)" for t, n, w in rows)
    common = ", ".join(f"'{t}'" for t in COMMON)
    return f"""
        WITH rarity(term, rarity) AS (VALUES {terms}), tw(term, template, w) AS (VALUES {vectors}),
        p AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '-') || '/' || doc_id // 200 AS above, coalesce(lang, '-') AS lang FROM documents),
        d AS (SELECT doc_id, text, above || CASE WHEN doc_id % 8 = 0 THEN '/LICENSE-' WHEN doc_id % 8 = 4 THEN '/' || lang || '/LICENSE-' ELSE '/' || lang || '/' END || doc_id || '.txt' AS path FROM p),
        l AS (SELECT doc_id, string_split(regexp_replace(text, '([.;!?])[ \t]+', '\\1' || chr(10), 'g'), chr(10)) AS l FROM d),
        u AS (
            SELECT doc_id, 0 AS line, text AS unit FROM d
            UNION ALL
            SELECT doc_id, 2 * i - 1 AS line, l[i] AS unit FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)
            UNION ALL
            SELECT doc_id, 2 * i AS line, array_to_string(l[i:i + {WINDOW - 1}], ' ') AS unit FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)
        ),
        w AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM u),
        t AS (SELECT doc_id, line, term, count(*) AS tf FROM w WHERE term NOT IN ({common}) GROUP BY ALL),
        x AS (SELECT doc_id, line, term, tf * coalesce(rarity, {other!r}::DOUBLE) AS x FROM t LEFT JOIN rarity USING (term)),
        n AS (SELECT doc_id, line, sqrt(sum(x * x)) AS len FROM x GROUP BY ALL),
        s AS (SELECT doc_id, line, string_split(template, '#')[1] AS licence, round(sum(x * w) / any_value(len), 6) AS score FROM x JOIN tw USING (term) JOIN n USING (doc_id, line) GROUP BY doc_id, line, template),
        m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line = 0 DESC, score DESC, licence DESC) AS r FROM s WHERE score >= {cosine}),
        own AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, licence, score, CASE WHEN line = 0 THEN 'file' WHEN licence IS NOT NULL THEN 'header' END AS origin
                FROM d LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (doc_id)),
        g AS (SELECT * FROM (SELECT dir AS above, licence AS gl, score AS gs, path AS gp, row_number() OVER (PARTITION BY dir ORDER BY origin = 'file' DESC, score DESC, licence DESC, path) AS r
                             FROM own WHERE origin = 'file' OR (licence IS NOT NULL AND path LIKE '%/LICENSE-%')) WHERE r = 1),
        up AS (SELECT dir, gl, gs, gp, row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) AS r
               FROM (SELECT DISTINCT dir FROM own) JOIN g ON above = '' OR dir = above OR starts_with(dir, above || '/'))
        SELECT doc_id, path, coalesce(licence, gl) AS licence, coalesce(score, gs) AS score,
               coalesce(origin, CASE WHEN gl IS NOT NULL THEN 'inherited' END) AS origin,
               CASE WHEN licence IS NOT NULL THEN path ELSE gp END AS from_path
        FROM own LEFT JOIN (SELECT * FROM up WHERE r = 1) USING (dir)"""
