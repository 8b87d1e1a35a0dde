"""Licence scan by sparse TF-IDF cosine and directory inheritance, in DataFrame functions only.

A file is read without comment marks, its hard-wrapped lines joined to paragraphs. Compared are the whole file, its paragraphs, its
sentences, and its lines, however long: each of these units that holds a licence cue becomes a sparse TF-IDF vector, and its cosine with
the vectors of licence templates is found by a join on terms. A unit without any cue word names no licence, by definition. Of the units with a cosine of at least ``least_cosine`` the widest kind decides (file,
paragraph, sentence, line), within it the largest cosine; a mere reservation of rights yields to any licence.

A licence file, by its name, as a whole, or because its best unit makes up ``file_share`` of its words, speaks for its
directory. Files without a licence of their own inherit from the nearest ancestor directory: distinct directories are joined with
all their ancestors' licences, the deepest wins, and files then look up their directory.

Templates are headers and licence texts given below, the paragraphs of the latter, and usual phrases built from names,
a bounded table; inverse document frequencies come from them, and a term that no template has gets the largest one.

Edge cases: a null or empty text has no licence of its own but may inherit. A null path is in no
directory. Repeated rows get the same result. Null ids are kept. Ties between templates go to the
first name in alphabetical order, between units of one kind to the earlier, between licence files of one
directory to the larger cosine, then the first name. An empty table gives an empty result. Further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import row_key
from gleanery.session import table

#: Identifiers of licences and the names that phrases call them by.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("Unlicense", "Unlicense"),
    ("Zlib", "zlib License"),
)
#: Phrases about a licence.
PHRASES = ("Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This project is licensed under the {} - see the LICENSE file for details")
#: Headers, titles of long licences and notices, as they are published.
HEADERS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole licence texts by paragraph, and whether the paragraphs alone tell the licence.
TEXTS = (
    ("BSD-2-Clause", (*_BSD, _BSD_END), False),
    ("BSD-3-Clause", (*_BSD, _BSD_NAME, _BSD_END), True),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ), True),
    ("MIT", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ), True),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    ), True),
)
CUE = r"(?i)licen[cs]e|copyright|rights reserved|spdx|public domain|creative commons|permission (?:is|to use)|redistribution and use|neither the name|provided .?as.is"
LICENCE_NAMES = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.-].*)?$"
LEAST_COSINE = 0.75
FILE_SHARE = 0.5
TERM = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
LAST_RESORT = "Proprietary"


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates, each once."""
    out = [*HEADERS]
    for name, title in NAMES:
        out += [(name, phrase.format(title)) for phrase in PHRASES] + [(name, f"SPDX-License-Identifier: {name}")]
    for name, paragraphs, tell in TEXTS:
        out.append((name, "\n".join(paragraphs)))
        out += [(name, p) for p in paragraphs if tell and re.search(CUE, p)]
    return list(dict.fromkeys(out))


def template_vectors() -> tuple[dict[str, float], float, list[tuple[int, str, dict[str, float]]]]:
    """Idf by term, that of terms in no template, and the unit vector of each template."""
    texts = templates()
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in texts]
    n = len(counts)
    idf = {t: math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1 for c in counts for t in c}
    out = []
    for i, ((name, _), c) in enumerate(zip(texts, counts, strict=True)):
        w = {t: (1 + math.log(tf)) * idf[t] for t, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append((i, name, {t: x / norm for t, x in w.items()}))
    return idf, math.log(1 + n) + 1, out


def bare(text: Column) -> Column:
    """Text without comment marks at the ends of its lines."""
    opened = F.regexp_replace(text, r"(?md)^[ \t]*+(?:[/*#;%|]++|-{2,}+|<!--|\"{3})?[ \t]*+", "")
    return F.regexp_replace(opened, r"(?md)(?<![ \t\r])[ \t\r]*+(?:\*++/|-->|\"{3})?[ \t\r]*+$", "")


def units(text: Column) -> Column:
    """[{kind, at, then, text}] of bare text: file 0, paragraphs 1, sentences 2, lines 3, by place."""
    unit = lambda kind, at, then, t: F.struct(F.lit(kind).alias("kind"), at.alias("at"), then.alias("then"), t.alias("text"))
    flat = lambda t: F.replace(t, F.lit("\n"), F.lit(" "))
    zero = F.lit(0)
    paragraphs = F.split(text, "\n{2,}")
    # A version's mark ends no sentence.
    sentences = lambda p: F.split(F.regexp_replace(flat(p), r"\b([vV]\.)\x20+", "$1"), r"(?<=[.;!?])\x20+")
    return F.concat(
        F.array(unit(0, zero, zero, flat(text))),
        F.transform(paragraphs, lambda p, i: unit(1, i, zero, flat(p))),
        F.flatten(F.transform(paragraphs, lambda p, i: F.transform(sentences(p), lambda s, j: unit(2, i, j, s)))),
        F.transform(F.split(text, "\n"), lambda line, i: unit(3, i, zero, line)),
    )


def own_licences(files: DataFrame, key: list[str], text_col: str, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(key, licence, cosine, share) of files with a licence of their own; share of its words in the file."""
    spark = files.sparkSession
    idf, rarest, vectors = template_vectors()
    terms = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    weights = spark.createDataFrame([(i, name, t, w) for i, name, v in vectors for t, w in v.items()], "template int, licence string, term string, weight double")
    found = files.where(F.col(text_col).rlike(CUE)).groupBy(*key).agg(F.first(text_col).alias("text"))
    term_list = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    place = [*key, "kind", "at", "then"]
    # The file's words are counted before its units are laid out, so the text itself is not carried along.
    counted = found.select(*key, F.size(term_list("text")).alias("words"), bare(F.col("text")).alias("bare"))
    laid = counted.select(*key, "words", F.explode(units(F.col("bare"))).alias("u")).where(F.col("u.text").rlike(CUE)).select(*key, "words", "u.kind", "u.at", "u.then", term_list("u.text").alias("terms"))
    tf = laid.select(*place, "words", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy(*place, "words", "size", "term").count()
    weighted = tf.join(F.broadcast(terms), "term", "left").withColumn("w", (1 + F.log("count")) * F.coalesce("idf", F.lit(rarest)))
    norms = weighted.groupBy(*place).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(weights), "term").groupBy(*place, "words", "size", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, place).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least_cosine)
    share = F.when(F.col("kind") == 0, 1.0).otherwise(F.col("size") / F.col("words"))
    best = scored.groupBy(*key).agg(
        F.min(F.struct((F.col("licence") == LAST_RESORT).alias("last"), "kind", (-F.col("cosine")).alias("c"), "at", "then", "licence", share.alias("share"))).alias("b")
    )
    return best.select(*key, F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), F.col("b.share").alias("share"))


def scan_licences(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    least_cosine: float = LEAST_COSINE,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """(id_col, licence, cosine, origin, directory) of each file; origin is own, inherited or none."""
    key = ["k1", "k2"]
    base = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), *row_key(id_col, path_col, text_col))
    own = own_licences(base, key, "text", least_cosine)
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    placed = base.select("_id", *key, F.when(F.col("path").isNotNull(), parent).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))
    placed = placed.join(own, key, "left")
    speaks = (F.col("share") >= file_share) | F.col("name").rlike(LICENCE_NAMES)
    by_dir = (
        placed.where(F.col("licence").isNotNull() & F.col("dir").isNotNull() & speaks)
        .groupBy(F.col("dir").alias("from"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
        .select("from", F.col("b.licence").alias("of_dir"), (-F.col("b.c")).alias("dir_cosine"))
    )
    steps = F.split("dir", "/")
    dirs = placed.select("dir").where(F.col("dir").isNotNull()).distinct().withColumn("steps", steps)
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("steps")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("steps", 1, n), "/").alias("from")))).alias("a"))
    near = (
        above.select("dir", "a.depth", "a.from")
        .distinct()
        .join(by_dir, "from")
        .groupBy("dir")
        .agg(F.max_by(F.struct("from", "of_dir", "dir_cosine"), "depth").alias("near"))
    )
    inherits = F.col("licence").isNull() & F.col("near").isNotNull()
    return placed.join(near, "dir", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("licence", "near.of_dir").alias("licence"),
        F.coalesce("cosine", "near.dir_cosine").alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("near.from")).alias("directory"),
    )


def document_path() -> Column:
    """A place for documents, which have none: three levels below their source, each tenth a level higher."""
    d = F.col("doc_id")
    hundred, ten = F.floor(d / 100), F.floor(d / 10)
    return F.when(d % 100 == 0, F.concat_ws("/", "source", d)).when(d % 10 == 0, F.concat_ws("/", "source", hundred, d)).otherwise(F.concat_ws("/", "source", hundred, ten, d))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text", document_path().alias("path")))


def oracle() -> str:
    """The same in SQL: the template vectors are written out as a table, and units are parted by marking where they end."""
    idf, rarest, vectors = template_vectors()
    terms = ", ".join(f"('{t}', {v!r})" for t, v in sorted(idf.items()))
    weights = ", ".join(f"({i}, '{name}', '{t}', {w!r})" for i, name, v in vectors for t, w in v.items())
    return f"""
WITH terms(term, idf) AS (VALUES {terms}), weights(template, licence, term, weight) AS (VALUES {weights}),
placed AS (
  SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN source WHEN doc_id % 10 = 0 THEN source || '/' || (doc_id // 100)
    ELSE source || '/' || (doc_id // 100) || '/' || (doc_id // 10) END AS dir FROM documents),
clean AS (
  SELECT doc_id, len(regexp_extract_all(lower(text), '{TERM}')) AS words,
    regexp_replace(regexp_replace(text, '(?m)^[ \\t]*(?:[/*#;%|]+|-{{2,}}|<!--|\"{{3}})?[ \\t]*', '', 'g'), '(?m)[ \\t\\r]*(?:[*]+/|-->|\"{{3}})?[ \\t\\r]*$', '', 'g') AS b
  FROM placed WHERE regexp_matches(text, '{CUE}')),
paragraphs AS (SELECT doc_id, words, unnest(ps) AS p, generate_subscripts(ps, 1) AS pl FROM (SELECT *, string_split(regexp_replace(b, '\\n{{2,}}', chr(1), 'g'), chr(1)) AS ps FROM clean)),
sentences AS (SELECT doc_id, words, pl, unnest(ss) AS s, generate_subscripts(ss, 1) AS th FROM (
  SELECT *, string_split(regexp_replace(regexp_replace(replace(p, chr(10), ' '), '\\b([vV][.])\\x20+', '\\1', 'g'), '([.;!?])\\x20+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM paragraphs)),
lines AS (SELECT doc_id, words, unnest(ls) AS l, generate_subscripts(ls, 1) AS pl FROM (SELECT *, string_split(b, chr(10)) AS ls FROM clean)),
unit AS (
  SELECT doc_id, words, 0 AS kind, 0 AS pl, 0 AS th, replace(b, chr(10), ' ') AS u FROM clean UNION ALL SELECT doc_id, words, 1, pl, 0, replace(p, chr(10), ' ') FROM paragraphs
  UNION ALL SELECT doc_id, words, 2, pl, th, s FROM sentences UNION ALL SELECT doc_id, words, 3, pl, 0, l FROM lines),
cued AS (SELECT doc_id, words, kind, pl, th, regexp_extract_all(lower(u), '{TERM}') AS ts FROM unit WHERE regexp_matches(u, '{CUE}')),
tf AS (
  SELECT doc_id, words, kind, pl, th, size, term, count(*) AS n
  FROM (SELECT doc_id, words, kind, pl, th, len(ts) AS size, unnest(ts) AS term FROM cued) GROUP BY ALL),
w AS (SELECT tf.*, (1 + ln(n)) * coalesce(idf, {rarest!r}) AS w FROM tf LEFT JOIN terms USING (term)),
norms AS (SELECT doc_id, kind, pl, th, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT doc_id, words, kind, pl, th, size, template, licence, sum(w * weight) AS dot FROM w JOIN weights USING (term) GROUP BY ALL),
own AS (
  SELECT doc_id, licence, cosine, share FROM (
    SELECT doc_id, licence, cosine, share, row_number() OVER (PARTITION BY doc_id ORDER BY licence = '{LAST_RESORT}', kind, cosine DESC, pl, th, licence) AS nth
    FROM (SELECT doc_id, kind, pl, th, licence, CASE WHEN kind = 0 THEN 1.0 ELSE size / words END AS share, round(dot / norm, 9) AS cosine FROM dots JOIN norms USING (doc_id, kind, pl, th)) WHERE cosine >= {LEAST_COSINE}) WHERE nth = 1),
files AS (SELECT p.doc_id, p.dir, o.licence, o.cosine, o.share FROM placed p LEFT JOIN own o USING (doc_id)),
by_dir AS (
  SELECT dir AS source_dir, licence AS of_dir, cosine AS dir_cosine FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) AS nth FROM files WHERE share >= {FILE_SHARE}) WHERE nth = 1),
near AS (
  SELECT d.dir, arg_max(b.source_dir, length(b.source_dir)) AS source_dir, arg_max(b.of_dir, length(b.source_dir)) AS of_dir, arg_max(b.dir_cosine, length(b.source_dir)) AS dir_cosine
  FROM (SELECT DISTINCT dir FROM files) d JOIN by_dir b ON d.dir = b.source_dir OR starts_with(d.dir, b.source_dir || '/') GROUP BY d.dir)
SELECT f.doc_id, coalesce(f.licence, n.of_dir) AS licence, coalesce(f.cosine, n.dir_cosine) AS cosine,
  CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN n.of_dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN f.licence IS NULL THEN n.source_dir END AS directory
FROM files f LEFT JOIN near n USING (dir)
"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": oracle()}
