"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Units of a text are its lines and its paragraphs (headers and notices, also wrapped over lines of a
comment; a line without letters and digits ends a paragraph) and the whole text (licence files). A unit's
vector has a term for every distinct token, weighted by its count and by the token's inverse
document frequency among the templates; tokens of no template get the largest such weight. The
cosine with each template is a join on tokens, so only tokens that a template has meet anything.

Before that, texts without any anchor token are put aside. Anchors are chosen so that a template
without them keeps less than the threshold's share of its norm; a unit that holds no anchor then
cannot reach the threshold, and nothing is lost.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small

THRESHOLD = 0.7
#: Template words that a unit must have, if the template has so many: "mit" alone is German, not a licence.
HITS = 2

#: Ends a paragraph, in the syntax that both engines share.
PARAGRAPH = r"\n(?:[^A-Za-z0-9\n]*\n)+"

#: Names of licence files, in the syntax that both engines share.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|legal|notice)s?([._-][^/]*)?$"

#: Licence names as notices write them.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0 public domain dedication"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3.0"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
}
_LEADS = ("Licensed under {}", "Released under the {}", "This work is licensed under the {}", "SPDX-License-Identifier: {}")
#: Openings of licence files.
_FILES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: The standard headers of source files, each as one line.
_HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. "
    "You should have received a copy of the GNU {0} License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_HEADERS += [(lic, _GNU.format(name, version)) for lic, name, version in (("AGPL-3.0", "Affero General Public", 3), ("GPL-2.0", "General Public", 2), ("GPL-3.0", "General Public", 3), ("LGPL-3.0", "Lesser General Public", 3))]
#: Full texts of licence files, one file a licence.
TEXTS = Path(__file__).parent / "license_texts"


#: Function words, which carry no weight in any vector.
STOP = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "new", "of", "on", "or", "that", "the", "this", "to", "under", "was", "with", "without", "you", "can")


#: Template words that are everyday words elsewhere.
FOREIGN = ("mit",)


def templates() -> list[tuple[str, str]]:
    out = []
    for lic, names in NAMES.items():
        out += [(lic, lead.format(lic if "SPDX" in lead else name)) for name in names for lead in _LEADS]
        out += [(lic, name) for name in names if len(name.split()) > 2]
    return list(dict.fromkeys(out + list(_FILES.items()) + _HEADERS + full_texts()))


def full_texts() -> list[tuple[str, str]]:
    return [(f.name[: -len(".txt")], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]


def tokens_of(text: str) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP]


def model(rows: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float, int, int]], dict[str, float], float, list[str]]:
    """Template vectors of unit length (template, licence, token, weight, tokens needed, tokens of a full text
    or 0), idf, idf of unknown tokens, anchors."""
    counts, whole = [Counter(tokens_of(t)) for _, t in rows], set(full_texts())
    df = Counter(w for c in counts for w in c)
    idf = {w: 1 + math.log((1 + len(rows)) / (1 + n)) for w, n in df.items()}
    unknown = 1 + math.log(1 + len(rows))
    vectors, anchors = [], set()
    for k, c in enumerate(counts):
        raw = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        unit = {w: x / norm for w, x in raw.items()}
        need = min(HITS, len(unit))
        size = c.total() if rows[k] in whole else 0
        vectors += [(k, rows[k][0], w, x, need, size) for w, x in sorted(unit.items())]
        rest = sum(x * x for w, x in unit.items() if w not in anchors)
        # Words that say "licence" first, then the heaviest, a common word of another language last; stop
        # once the rest is too light or has too few words.
        for w in sorted(unit, key=lambda w: (w in FOREIGN, not re.match("licen|spdx|copyright|creative|unlicense", w), -unit[w], w)):
            if math.sqrt(max(0.0, rest)) < THRESHOLD - 1e-9 or sum(t not in anchors for t in unit) < need:
                break
            if w not in anchors:
                anchors.add(w)
                rest -= unit[w] ** 2
    return vectors, idf, unknown, sorted(anchors)


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _best(units: DataFrame, spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """``units(rid, whole, unit, text)`` -> best template of each row's parts, of its whole text, and of its
    whole text among the full texts of at most twice its length."""
    vectors, idf, unknown, _ = model(rows)
    weights = F.broadcast(spark.createDataFrame(vectors, "template int, license string, token string, weight double, need int, size int"))  # fixed size
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "token string, idf double"))  # fixed size
    terms = units.select("rid", "whole", "unit", F.explode(_tokens(F.col("text"))).alias("token")).filter(~F.col("token").isin(*STOP)).groupBy("rid", "whole", "unit", "token").agg(F.count("*").alias("n"))
    heavy = terms.join(idfs, "token", "left").select("rid", "whole", "unit", "token", "n", (F.col("n") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norms = heavy.groupBy("rid", "whole", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("tokens"))
    dots = heavy.join(weights, "token").groupBy("rid", "whole", "unit", "template", "license", "need", "size").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count("*").alias("hits")).filter("hits >= need")
    full = F.col("whole") & (F.col("size") > 0) & (2 * F.col("tokens") >= F.col("size"))
    scored = dots.join(norms, ["rid", "whole", "unit"]).select("rid", "whole", "license", full.alias("full"), F.round(F.col("dot") / F.col("norm"), 4).alias("score")).filter(F.col("score") >= THRESHOLD)
    pick = F.max(F.struct(F.col("score"), F.col("license"))).alias("best")
    return scored.groupBy("rid", "whole", "full").agg(pick).select("rid", "whole", "full", F.col("best.score").alias("score"), F.col("best.license").alias("license"))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, path, license, score, origin, license_dir)`` for each row of ``docs``.

    ``origin``: ``file`` when the whole text is a licence and the name says so too (LICENSE, COPYING, NOTICE and the
    like) or it is a licence's full text, ``header`` when it, a line or a paragraph of it is a notice, ``inherited`` from the licence file in the nearest directory above, else null. Of several licences
    the best cosine wins, then the greater name; a directory with several licence files likewise.
    Null or empty texts have no licence of their own; null paths inherit nothing; repeated rows each get
    their row; further columns are ignored; an empty table gives an empty table.
    """
    spark, rows = docs.sparkSession, templates()
    anchors = model(rows)[3]
    base = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    anchored = lambda c: F.rlike(F.lower(c), F.lit("(?<![a-z0-9])(?:" + "|".join(anchors) + ")(?![a-z0-9])"))
    # Texts are looked through once; only those with an anchor are written down.
    seen = base.select("doc_id", "path", F.when(anchored(F.col("text")), F.col("text")).alias("text"))
    seen = materialise(seen.withColumn("rid", F.monotonically_increasing_id()), "anchored")
    marked = seen.filter("text is not null")
    lines = marked.select("rid", F.lit(False).alias("whole"), F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    blocks = marked.select("rid", F.lit(False).alias("whole"), F.posexplode(F.split("text", PARAGRAPH)).alias("unit", "text")).withColumn("unit", -1 - F.col("unit"))
    parts = lines.unionByName(blocks.filter(F.contains("text", F.lit("\n")))).filter(anchored(F.col("text")))
    units = parts.unionByName(marked.select("rid", F.lit(True).alias("whole"), F.lit(0).alias("unit"), "text"))
    best = materialise(_best(units, spark, rows), "licensed")
    own = best.groupBy("rid").agg(*(F.max(F.struct(is_file.alias("file"), "score", "license")).alias(n) for n, is_file in (("named", F.col("whole")), ("other", F.col("full")))))
    b = F.when(F.col("path").rlike(FILE_NAME), F.col("named")).otherwise(F.col("other"))
    every = seen.drop("text").join(own, "rid", "left").withColumn("b", b)
    every = every.select("doc_id", "path", F.col("b.license").alias("license"), F.col("b.score").alias("score"), F.when(F.col("b.file"), "file").when(F.col("b.license").isNotNull(), "header").alias("origin"))
    every = materialise(every, "owned").withColumn("dir", parent(F.col("path")))
    return inherit(every)


def inherit(files: DataFrame) -> DataFrame:
    """Fill ``license`` from the nearest ancestor directory that holds a licence file. Directories are
    reduced to distinct ones before any join, so a directory of many files counts once."""
    licensed = files.filter("origin = 'file' and path is not null").groupBy("dir").agg(F.max(F.struct("score", "license")).alias("b"))
    licensed = materialise(licensed.select(F.col("dir").alias("up"), F.col("b.license").alias("from_license"), F.col("b.score").alias("from_score")), "licensed-dirs")
    dirs = files.filter("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))).alias("up")).distinct()
    near = ups.join(licensed, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "from_license", "from_score")).alias("b"))
    near = materialise(near.select("dir", F.col("b.up").alias("up"), F.col("b.from_license").alias("from_license"), F.col("b.from_score").alias("from_score")), "nearest")
    inherited = F.col("license").isNull() & F.col("from_license").isNotNull()
    return files.join(small(near), "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "from_license").alias("license"),
        F.when(inherited, F.col("from_score")).otherwise(F.col("score")).alias("score"),
        F.when(inherited, "inherited").otherwise(F.col("origin")).alias("origin"),
        F.when(inherited, F.col("up")).when(F.col("origin") == "file", F.col("dir")).alias("license_dir"),
    )


def op4_sql() -> str:
    """DuckDB: all lines and whole texts against all templates, without anchors."""
    vectors, idf, unknown, _ = model(templates())
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    vec = ",".join(f"({k},{quote(lic)},{quote(w)},{x!r}::DOUBLE,{need},{size})" for k, lic, w, x, need, size in vectors)
    idfs = ",".join(f"({quote(w)},{x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    return f"""
WITH v(template, license, token, weight, need, size) AS (VALUES {vec}), i(token, idf) AS (VALUES {idfs}),
d AS (SELECT doc_id, concat(source, '/', lang, '/', doc_id) AS path, concat(source, '/', lang) AS dir, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, false AS whole, unnest(range(len(string_split(text, chr(10))))) AS unit, unnest(string_split(text, chr(10))) AS text FROM d
  UNION ALL SELECT doc_id, false, -1 - unnest(range(len(p))), unnest(p) FROM (SELECT doc_id, string_split_regex(text, {quote(PARAGRAPH)}) AS p FROM d)
  UNION ALL SELECT doc_id, true, 0, text FROM d),
t AS (SELECT doc_id, whole, unit, token, count(*) AS n FROM (SELECT doc_id, whole, unit, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM l) WHERE token NOT IN ({", ".join(map(quote, STOP))}) GROUP BY ALL),
h AS (SELECT t.*, n * coalesce(idf, {unknown!r}::DOUBLE) AS w FROM t LEFT JOIN i USING (token)),
n AS (SELECT doc_id, whole, unit, sqrt(sum(w * w)) AS norm, sum(n) AS tokens FROM h GROUP BY ALL),
p AS (SELECT doc_id, whole, unit, template, license, size, sum(w * weight) AS dot FROM h JOIN v USING (token) GROUP BY doc_id, whole, unit, template, license, need, size HAVING count(*) >= need),
s AS (SELECT doc_id, whole AND (regexp_matches(path, {quote(FILE_NAME)}) OR size > 0 AND 2 * tokens >= size) AS whole, license, round(dot / norm, 4) AS score FROM p JOIN n USING (doc_id, whole, unit) JOIN d USING (doc_id) WHERE round(dot / norm, 4) >= {THRESHOLD}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY whole DESC, score DESC, license DESC) = 1),
f AS (SELECT d.doc_id, path, dir, license, score, CASE WHEN whole THEN 'file' WHEN license IS NOT NULL THEN 'header' END AS origin FROM d LEFT JOIN b USING (doc_id)),
u AS (SELECT dir AS up, license AS from_license, score AS from_score FROM f WHERE origin = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) = 1),
g AS (SELECT f.doc_id, u.* FROM f JOIN u ON f.dir = u.up OR starts_with(f.dir, u.up || '/') OR u.up = ''
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(up) DESC, up DESC) = 1)
SELECT f.doc_id, path, coalesce(license, from_license) AS license, CASE WHEN license IS NULL THEN from_score ELSE score END AS score,
  CASE WHEN license IS NULL AND from_license IS NOT NULL THEN 'inherited' ELSE origin END AS origin,
  CASE WHEN license IS NULL THEN up WHEN origin = 'file' THEN dir END AS license_dir
FROM f LEFT JOIN g USING (doc_id)"""
