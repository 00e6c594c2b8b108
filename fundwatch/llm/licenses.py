"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Units are the lines of every whole text, its paragraphs of several lines, and, for a file named
like a licence file, the text itself. A unit's vector has the tokens of the templates, weighted
by count times idf (document frequencies over all documents), and one dimension of weight 1
for each other token. Only units that can reach the threshold are compared: for each template
the tokens in fewest documents are taken until the rest of its vector is too short for the cosine,
so a unit without any of them cannot match (nothing that could match is left out).

A file without a licence of its own takes that of the nearest directory above that has a
licence file. Directories, not files, are joined with their ancestors; files then look up
their own directory, in ``SALTS`` parts so that one directory may hold a third of all files.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import written

THRESHOLD, SALTS = 0.75, 16
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
# Names of licences in the SPDX list and their usual statements.
STATEMENTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# The operative texts of short licences, and the notices that longer ones ask for in files.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
     "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD.format("", "") + _BSD_END),
    ("BSD-3-Clause", _BSD.format("", "") + _BSD_NAMES.format("", "", "") + _BSD_END),
    ("BSD-2-Clause", _BSD.format("1. ", "2. ") + _BSD_END),
    ("BSD-3-Clause", _BSD.format("1. ", "2. ") + _BSD_NAMES.format("", "", "3. ") + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
]
STATEMENTS += TEXTS
TEMPLATES = STATEMENTS + [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in STATEMENTS)]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


class Vocabulary:
    """Weights of the templates' tokens under the documents' frequencies; sized by the templates alone."""

    def __init__(self, docs: DataFrame, templates: list[tuple[str, str]], threshold: float):
        counted = [(name, dict((t, len([x for x in found if x == t])) for t in found)) for name, text in templates for found in [re.findall(TOKEN, text.lower())]]
        words = sorted({t for _, tf in counted for t in tf})
        own = F.array_intersect(F.array(*map(F.lit, words)), tokens(F.col("text")))
        df = {r["term"]: r["n"] for r in docs.select(F.explode(own).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = docs.filter(F.col("text").isNotNull()).count()
        self.idf = {w: round(log((1 + total) / (1 + df.get(w, 0))) + 1, 9) for w in words}
        self.rows, needed = [], set()
        for number, (name, tf) in enumerate(counted):
            weight = {t: n * self.idf[t] for t, n in tf.items()}
            norm = sum(w * w for w in weight.values()) ** 0.5
            self.rows += [(t, number, name, w / norm) for t, w in sorted(weight.items())]
            rest = norm**2
            for t in sorted(weight, key=lambda t: (df.get(t, 0), -weight[t], t)):
                if (max(0.0, rest) ** 0.5) / norm < threshold - 1e-9:
                    break
                needed.add(t)
                rest -= weight[t] ** 2
        self.needed = "(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(needed))) + ")(?![a-z0-9])"

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        terms = spark.createDataFrame(list(self.idf.items()), "term string, idf double")
        return F.broadcast(terms), F.broadcast(spark.createDataFrame(self.rows, "term string, template int, license string, w double"))


def units(files: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``files`` with ``units`` in place of the text: the lines, paragraphs and whole licence files that may reach the threshold."""
    near = lambda c: F.lower(c).rlike(vocabulary.needed)
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", r"\n[^\S\n]*\n"), lambda p: p.contains("\n"))
    whole = F.when(named_license(F.col("path")), F.array("text")).otherwise(F.array().cast("array<string>"))
    return files.withColumn("units", F.when(near(F.col("text")), F.filter(F.concat(lines, paragraphs, whole), near))).drop("text")


def matches(rows: DataFrame, vocabulary: Vocabulary, threshold: float = THRESHOLD) -> DataFrame:
    """row, unit, license, score: the best template of each unit of ``rows`` (row, units) at or above the threshold."""
    terms, weights = vocabulary.frames(rows.sparkSession)
    each = rows.select("row", F.posexplode("units").alias("unit", "text"))
    counted = each.select("row", "unit", F.explode(tokens(F.col("text"))).alias("term")).groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    valued = written(counted.join(terms, "term", "left").select("row", "unit", "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("v")), "license-terms")
    norms = valued.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = valued.join(weights, "term").groupBy("row", "unit", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(norms, ["row", "unit"]).select("row", "unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    return scored.groupBy("row", "unit").agg(*best("license", F.col("score")))


def best(name: str, score: Column) -> list[Column]:
    """The license of the highest score, ties to the first name, and that score."""
    top = F.min(F.struct((-score).alias("low"), F.col(name).alias("license")))
    return [top["license"].alias("license"), (-top["low"]).alias("score")]


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def named_license(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "").rlike(LICENSE_FILE)


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, basis, licensed_by of every row of ``files`` (doc_id, path, text).

    basis: ``header`` (a line or paragraph of its own), ``file`` (a licence file), ``inherited``
    (then licensed_by is the directory whose licence files give it, else null) or ``none``
    (license and score null). Of several statements the highest score counts, ties go to the
    first name; several licence files of a directory are treated alike. Null and empty texts
    hold no statement; a null path has no directory and inherits nothing. Rows are told apart by
    a number that is written with them once, so repeated and null doc_ids keep their rows,
    whatever the files come out of; other columns are ignored.
    """
    files = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), "path", "text")
    vocabulary = Vocabulary(files, templates, threshold)
    rows = written(units(files.withColumn("row", F.monotonically_increasing_id()), vocabulary), "license-units")
    own = written(matches(rows, vocabulary, threshold).groupBy("row").agg(*best("license", F.col("score"))), "licenses")
    named = F.coalesce(named_license(F.col("path")), F.lit(False))
    known = written(rows.select("doc_id", "path", "row", named.alias("named"), directory(F.col("path")).alias("dir")).join(own, "row", "left"), "files")
    given = written(known.filter("named AND license IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(*best("license", F.col("score"))), "licensed-directories")
    dirs = known.filter("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nearest = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(given, "above").groupBy("dir").agg(
        F.max(F.struct(F.length("above").alias("n"), "above", F.col("license").alias("given"), F.col("score").alias("given_score"))).alias("by"))
    nearest = written(nearest.select("dir", "by.above", "by.given", "by.given_score"), "inherited")
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    without = known.filter("license IS NULL").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    # The number of directories has no bound, and a small file of them may be large in memory: no broadcast.
    heirs = without.join(salted.hint("merge"), ["dir", "salt"], "left").select(
        "doc_id", "path", F.col("given").alias("license"), F.col("given_score").alias("score"), F.when(F.col("given").isNull(), "none").otherwise("inherited").alias("basis"), F.when(F.col("given").isNotNull(), F.col("above")).alias("licensed_by"))
    owners = known.filter("license IS NOT NULL").select("doc_id", "path", "license", "score", F.when(F.col("named"), "file").otherwise("header").alias("basis"), F.lit(None).cast("string").alias("licensed_by"))
    return owners.unionByName(heirs)
