"""License scans [DataFrame functions only].

A text is compared in units: each of its lines, and word windows of 16 to 256 words that overlap by three quarters and
together cover the whole text, so that a notice counts the same on one line, wrapped, or within a long text. Units and
templates are TF-IDF vectors over all their words (term counts times smoothed idf over the files of the corpus), and the
cosine has the full norm on both sides. A file takes the licence of its best unit that reaches ``LEAST``. A file that
says nothing takes that of the nearest directory above it which has a licence file: paths are joined by directory, one
row for each directory and ancestor, and the deepest ancestor wins.

Units are dropped before scoring by bounds that no unit at ``LEAST`` fails (``needed``, and norms from below), and by one
rule that is not such a bound: a unit with under LEAST ** 2 of a wording's words is not compared with that wording.
Template weights are literals (bounded by the templates); whatever grows is joined by key, on staged tables, so that
Spark can split a hot word, unit or directory.

Null texts and texts without such units declare nothing; a null path is in no directory. Of several licences in one
file, or licence files in one directory, the highest cosine wins, then the smallest name. A path that comes
twice is one file. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import stage

#: Names and wordings of licence notices. One that is used alone is a wording of its own.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 3. This program is free software."),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": ("Released, distributed and licensed under the MIT License.", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Headers and whole licences of some hundred words; of longer licences, how the text opens.
TEXTS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.',
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "CC0-1.0": (
        'Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER.',
        'Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all',
    ),
    "GPL-3.0": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
        'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.',
    ),
    "LGPL-3.0": (
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
        'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.',
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
        'Mozilla Public License Version 2.0 ================================== 1. Definitions -------------- 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.',
    ),
}
TEMPLATES = {n: (*((t,) if isinstance(t, str) else t), *TEXTS.get(n, ())) for n, t in TEMPLATES.items()}
#: Least cosine of a declaration; names of licence files; words of a unit's windows.
LEAST = 0.45
FILE_NAMES = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
WORD = "[a-z]+|[0-9]+"
SIZES = (16, 32, 64, 128, 256)


def _counts(text: str) -> dict[str, int]:
    return dict(sorted(Counter(re.findall(WORD, text.lower())).items()))


def wordings(templates: Mapping[str, str | tuple[str, ...]]) -> list[tuple[str, dict[str, int]]]:
    """Licence and word counts of each wording, by name."""
    return [(n, _counts(t)) for n in sorted(templates) for t in ((templates[n],) if isinstance(templates[n], str) else templates[n])]


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def needed(vector: Mapping[str, float], idf: Mapping[str, float]) -> tuple[list[str], int]:
    """Words of a template and how many of them a unit has at least if their cosine reaches ``LEAST``.

    By Cauchy-Schwarz the words that both have carry LEAST ** 2 of the template's squared norm. The commonest words are left
    out while they carry at most half of that; the rest must then come from the others, of which the heaviest are counted.
    """
    square = sum(v * v for v in vector.values())
    rest, kept = 0.999 * LEAST**2 * square, dict(vector)
    for w in sorted(vector, key=lambda w: (idf[w], w)):
        if rest - vector[w] ** 2 < 0.999 * LEAST**2 * square / 2:
            break
        rest -= kept.pop(w) ** 2
    few = 0
    for v in sorted(kept.values(), reverse=True):
        few, rest = few + 1, rest - v * v
        if rest <= 0:
            break
    return sorted(kept), few


def units_of(files: DataFrame, possible: Callable[[Column], Column], place: Callable[[Column], Column], near: Callable[[Column], Column]) -> DataFrame:
    """path, line (of the first word) and words of the units of each ``possible`` text that are ``near``; files: path, text.

    ``place`` is a word's place among those of the templates, from 1, or 0; ``near`` is told the places of a unit's words.
    """
    by_line = F.transform(F.split("text", "\\r\\n|\\r|\\n"), words_in)
    texts = files.select("path", by_line.alias("by_line")).withColumn("words", F.flatten("by_line")).where(possible(F.col("words")))
    texts = texts.withColumn("line_of", F.flatten(F.transform("by_line", lambda ws, k: F.array_repeat(k, F.size(ws)))))
    n = F.size("words")

    def windows(s: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil((n - s) / (s // 4))).cast("int")
        all_of = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * (s // 4)).alias("at"), F.lit(s).alias("size")))
        return all_of if s == SIZES[0] else F.when(n > s // 2, all_of).otherwise(F.array().cast("array<struct<at:int,size:int>>"))

    lines = F.transform(F.filter(F.transform("by_line", lambda ws, k: F.struct(k.alias("k"), F.size(ws).alias("size"))), lambda x: (x["size"] > 0) & (x["size"] <= SIZES[-1])), lambda x: F.struct((F.array_position("line_of", x["k"]) - 1).cast("int").alias("at"), x["size"].alias("size")))
    texts = texts.withColumn("places", F.transform("words", place))
    units = F.filter(F.array_distinct(F.concat(lines, *map(windows, SIZES))), lambda u: near(F.slice("places", u["at"] + 1, u["size"])))
    cut = texts.select("path", F.explode(F.transform(units, lambda u: F.struct(F.element_at("line_of", u["at"] + 1).alias("line"), F.slice("words", u["at"] + 1, u["size"]).alias("words")))).alias("u"))
    return cut.select("path", "u.line", "u.words")


def declared(files: DataFrame, templates: Mapping[str, str | tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """path, licence, cosine, line: the best declaration of each file that has one; files: path, text."""
    spark, said = files.sparkSession, wordings(templates)
    seen = stage(files.where("text is not null").select(F.explode(F.concat(F.array_distinct(words_in(F.col("text"))), F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("files")), "words")
    vocabulary = sorted({w for _, c in said for w in c})
    files_with = {r["word"]: r["files"] for r in seen.where(F.col("word").isin("", *vocabulary)).collect()}
    total = files_with.get("", 0)  # every text counts the empty word once
    idf = {w: math.log((1 + total) / (1 + files_with.get(w, 0))) + 1 for w in vocabulary}
    vectors = [{w: n * idf[w] for w, n in c.items()} for _, c in said]
    norms = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]
    cues = [needed(x, idf) for x in vectors]
    literal = lambda ws: F.array(*map(F.lit, ws))

    def possible(words: Column) -> Column:
        known = F.array_intersect(words, literal(sorted({w for ws, _ in cues for w in ws})))
        return F.exists(F.array(known), lambda k: functools.reduce(Column.__or__, (F.size(F.array_intersect(k, literal(ws))) >= few for ws, few in cues)))

    places = F.create_map(*(F.lit(x) for k, w in enumerate(vocabulary) for x in (w, k + 1)))
    shares = [F.array(*(F.lit(x.get(w, 0.0) * idf[w] / m) for w in vocabulary)) for x, m in zip(vectors, norms, strict=True)]
    largest = F.array(*(F.lit(max(x.get(w, 0.0) * idf[w] / m for x, m in zip(vectors, norms, strict=True))) for w in vocabulary))
    squares = F.array(*(F.lit(idf[w] ** 2) for w in vocabulary))
    add = lambda known, values: F.aggregate(known, F.lit(0.0), lambda s, k: s + F.element_at(values, k))

    def near_any(unit: Column) -> Column:
        """Whether some cosine may reach LEAST: foreign words weigh 1 at least, and counts are at most their squares."""

        def judge(x: Column) -> Column:
            low = 0.999 * LEAST * F.sqrt(add(x, squares) + F.size(unit) - F.size(x))
            dot = F.greatest(*(F.when(F.size(unit) >= LEAST**2 * sum(c.values()), add(x, v)).otherwise(0.0) for v, (_, c) in zip(shares, said, strict=True)), F.lit(0.0))
            return (add(x, largest) >= low) & (dot >= low)

        return F.exists(F.array(F.array_remove(unit, 0)), lambda x: F.when(F.size(x) > 0, judge(x)).otherwise(False))

    found = stage(units_of(files.where("text is not null"), possible, lambda w: F.coalesce(places[w], F.lit(0)), near_any).withColumn("unit", F.md5(F.array_join("words", " "))), "units")
    # Units of the same words are scored once. What a foreign word weighs is at least 1: that bounds the cosine before any join.
    units = found.groupBy("unit").agg(F.first("words").alias("words"))
    table = spark.createDataFrame([(w, idf[w], [x.get(w, 0.0) * idf[w] / m for x, m in zip(vectors, norms, strict=True)]) for w in vocabulary], "word string, idf double, share array<double>")
    tf = units.select("unit", F.explode("words").alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf")).join(F.broadcast(table), "word", "left")
    # A unit with under LEAST ** 2 of a wording's words gets to LEAST only by one that is repeated there ("License"): no match.
    dots = [F.when(F.sum("tf") >= LEAST**2 * sum(c.values()), F.sum(F.coalesce(F.col("tf") * F.col("share")[k], F.lit(0.0)))).otherwise(0.0) for k, (_, c) in enumerate(said)]
    sums = tf.groupBy("unit").agg(F.array(*dots).alias("dots"), F.sum((F.col("tf") * F.coalesce("idf", F.lit(1.0))) ** 2).alias("least"))
    near = stage(sums.where(F.array_max("dots") >= 0.999 * LEAST * F.sqrt("least")).join(units, "unit"), "near")
    # The norm over all words, with the idf of each.
    each = near.select("unit", F.explode("words").alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf")).join(seen, "word")
    weight = F.log(F.lit(1.0 + total) / (1 + F.col("files"))) + 1
    norm = each.groupBy("unit").agg(F.sqrt(F.sum((F.col("tf") * weight) ** 2)).alias("norm"))
    best = F.array_max(F.array(*(F.struct(F.round(F.col("dots")[k] / F.col("norm"), 9).alias("cosine"), F.lit(-k).alias("order"), F.lit(n).alias("licence")) for k, (n, _) in enumerate(said))))
    scored = stage(near.join(norm, "unit").select("unit", best.alias("best")).where(F.col("best.cosine") >= LEAST), "scored")
    first = F.max_by(F.struct("best.licence", "best.cosine", "line"), F.struct("best.cosine", "best.order", -F.col("line")))
    return found.select("path", "line", "unit").join(scored, "unit").groupBy("path").agg(first.alias("x")).select("path", "x.licence", "x.cosine", "x.line")


def directory_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame, notice: Column | None = None) -> DataFrame:
    """path, licence, origin (file, directory or null), cosine and directory for every row of ``files`` (path, text).

    ``notice`` says of a declaration (path, line) whether its file is the licence file of its directory: by default by
    its name.
    """
    notice = F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAMES) if notice is None else notice
    own = stage(declared(files), "declared")
    at = own.where(notice).withColumn("directory", directory_of(F.col("path")))
    by_dir = at.groupBy("directory").agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence"))).alias("given"))
    # Directories are far fewer than files: each is joined to its ancestors that have a licence, the deepest of which wins.
    rows = files.select("path")
    dirs = rows.select(directory_of(F.col("path")).alias("directory")).where("directory is not null").distinct()
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = dirs.select("directory", F.posexplode(F.array_distinct(up)).alias("depth", "ancestor"))
    near = above.join(by_dir.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max_by("given", "depth").alias("given"), F.max_by("ancestor", "depth").alias("from_directory"))
    near = stage(near, "inherited")
    out = rows.withColumn("directory", directory_of(F.col("path"))).join(own.drop("line"), "path", "left").join(near, "directory", "left")
    return out.select(
        "path", F.coalesce("licence", "given.licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), "file").when(F.col("given").isNotNull(), "directory").alias("origin"),
        F.coalesce("cosine", "given.cosine").alias("cosine"), F.when(F.col("licence").isNull(), F.col("from_directory")).alias("from_directory"),
    )
