"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units are every line of a text, every run of up to RUN consecutive lines (notices that wrap;
comment marks are no terms) and the text as a whole (licence files). A unit's sparse vector
weighs each term by 1 + ln(count) and inverse document frequency; document frequencies of the
templates' terms are counted over all documents, and a term of no template weighs like one
found in a single document. A unit within THRESHOLD of a template has its licence. Templates
are notices, titles and whole licence texts; a licence may have several. By the
prefix-filtering rule only units with one of a template's anchors (its heaviest terms, without
which no cosine reaches THRESHOLD) are vectorised; nothing is lost. A licence text of more than
RUN lines inside a longer file is found by its title or notice only.

A directory's licences are those of the licence files directly in it. A file without a
licence of its own takes those of its nearest ancestor that has any: the distinct directories,
far fewer than files, are joined with their ancestors' paths, then files with directories.

Defined results: null and empty texts have no licence of their own; ties go to the licence
first by name; several licences at one directory: the first by name; null paths inherit
nothing; repeated rows stay; an empty table gives no rows; very long texts are scanned whole;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.storage import stored

THRESHOLD = 0.8

RUN = 4

# Notices, titles and texts by which public licences are declared.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-clause license."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "This library is free software under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_TERM = "[a-z0-9]+"


def template_terms(templates=TEMPLATES) -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(_TERM, text.lower()))) for name, text in templates]


def _anchors(vectors: list[dict[str, float]], threshold: float) -> set[str]:
    out = set()
    for v in vectors:
        whole, rest = math.sqrt(sum(x * x for x in v.values())), 0.0
        for t, x in sorted(v.items(), key=lambda y: (y[1], y[0])):
            rest += x * x
            if math.sqrt(rest) >= threshold * whole * (1 - 1e-9):
                out.add(t)
    return out


def _runs(lines):
    """The bags of every run of 1 to RUN consecutive lines; null where a run would pass the end."""
    runs = [lines]
    for k in range(2, RUN + 1):
        runs.append(F.zip_with(runs[-1], F.slice(lines, k, F.greatest(F.size(lines), F.lit(1))), lambda a, b: F.concat(a, b)))
    return F.concat(*runs)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, score, whole (the text as a whole has it): the best of each document that has one."""
    spark = docs.sparkSession
    terms = template_terms(templates)
    names = sorted({t for _, c in terms for t in c})
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    bag = F.regexp_extract_all("low", F.lit(f"({_TERM})"), F.lit(1))
    seen = texts.select(F.explode(F.array_intersect(F.array_distinct(bag), F.array(*map(F.lit, names)))).alias("term")).groupBy("term").count().collect()  # at most the templates' terms
    n = docs.count()
    df = {r["term"]: r["count"] for r in seen}
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in names}
    other = math.log((1 + n) / 2) + 1
    vectors = [{t: (1 + math.log(k)) * idf[t] for t, k in c.items()} for _, c in terms]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    anchors = F.array(*map(F.lit, sorted(_anchors(vectors, threshold))))
    with_any = texts.filter(F.arrays_overlap(bag, anchors))
    lines = F.transform(F.split("low", "\n"), lambda x: F.regexp_extract_all(x, F.lit(f"({_TERM})"), F.lit(1)))
    runs = with_any.select("doc_id", lines.alias("lines")).select("doc_id", F.explode(F.filter(_runs(F.col("lines")), lambda b: b.isNotNull() & F.arrays_overlap(b, anchors))).alias("bag"), F.lit(False).alias("whole"))
    units = runs.unionByName(with_any.select("doc_id", bag.alias("bag"), F.lit(True).alias("whole")))
    units = units.select(F.md5(F.array_join("bag", " ")).alias("unit"), "doc_id", "whole", "bag").dropDuplicates(["unit", "doc_id", "whole"])
    # counts by term within the unit, then its dot product with each template and its norm
    unit = units.select("unit", "doc_id", "whole", F.explode("bag").alias("t")).groupBy("unit", "doc_id", "whole", "t").agg(F.count("*").alias("k"))
    known = spark.createDataFrame([(t, idf[t], [v.get(t, 0.0) for v in vectors]) for t in names], "t string, idf double, ws array<double>")  # the templates' terms, whatever the input
    weighed = unit.join(F.broadcast(known), "t", "left").withColumn("w", (1 + F.log("k")) * F.coalesce("idf", F.lit(other)))
    dots = [F.sum(F.col("w") * F.coalesce(F.col("ws")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(vectors))]
    scored = weighed.groupBy("unit", "doc_id", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("license"), F.round(F.col(f"d{i}") / (F.col("norm") * F.lit(norms[i])), 6).alias("score")) for i, (name, _) in enumerate(terms))))
    hits = scored.select("doc_id", "whole", each.alias("x")).filter(F.col("x.score") >= threshold).select("doc_id", "whole", "x.*")
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.max("whole").alias("whole"))
    return best.select("doc_id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "whole")


def inherit(files: DataFrame) -> DataFrame:
    """files (doc_id, path, license, score, is_license_file) with directory and effective licence: own, else the nearest ancestor directory's."""
    files = files.withColumn("directory", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)).when(F.col("path").isNotNull(), F.lit("")))
    licensed = files.filter("is_license_file and license is not null and directory is not null").groupBy(F.col("directory").alias("up")).agg(F.min("license").alias("given"))
    directories = files.filter("directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = directories.withColumn("parts", parts).select("directory", F.explode(F.expr("transform(sequence(0, size(parts)), k -> struct(k as depth, array_join(slice(parts, 1, k), '/') as up))")).alias("a")).select("directory", "a.*").distinct()
    nearest = above.join(licensed, "up").groupBy("directory").agg(F.max(F.struct("depth", "given", "up")).alias("n")).select(F.col("directory").alias("_d"), F.col("n.given").alias("inherited"), F.col("n.up").alias("from_directory"))
    joined = files.join(nearest, F.col("directory") == F.col("_d"), "left").drop("_d")
    own = F.col("license").isNotNull()
    return joined.withColumn("effective", F.coalesce("license", "inherited")).withColumn("from_directory", F.when(~own, F.col("from_directory")))


def scan_tree(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, effective, from_directory. files: doc_id, path, text; a licence file is named LICENSE or COPYING, or is as a whole near a template."""
    found = stored(scan(files, templates, threshold), "licences").withColumnRenamed("doc_id", "_id")
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)\z", 1).isin("LICENSE", "COPYING"), F.lit(False))
    joined = files.select("doc_id", "path").join(found, F.col("doc_id") == F.col("_id"), "left").withColumn("is_license_file", named | F.coalesce("whole", F.lit(False)))
    return inherit(joined).select("doc_id", "path", "license", "score", "effective", "from_directory")
