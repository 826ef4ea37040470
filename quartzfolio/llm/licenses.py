"""License scans by sparse TF-IDF cosine, and inheritance by directory.

Notices are the lines of a file that hold a cue word, its comment blocks with
one (a header that goes over several lines), and the whole text of a licence
file. Texts are read once, into a table of notices. Equal notices are one row
with a count from there on, so that a notice in a third of all files weighs no
more than another. Terms are weighted over all notices and templates; a notice
takes the template with the highest cosine. A file without a notice of its own
inherits from the licence file in the nearest directory above, by joins on
paths. All of it is DataFrame operations.

Defined results. Null and empty texts have no notice and may inherit. Very long
texts are searched to their end. Scores are rounded to six digits before they
are compared; ties go to the first name, those of several licence files in a
directory to the first path. Null paths have no directory and inherit nothing.
Rows are told apart by a number of their own: repeated rows give repeated rows,
and equal keys may have different texts. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.llm.common import join_by_weight, materialize

CUES = r"(?i)licen[cs]e|copyright|spdx|public domain|warranty"
SEPARATORS = "[^a-z0-9]+"
LICENCE_FILE = r"(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"
THRESHOLD = 0.6
#: A comment line, and lines of it in a row (possessive: no deep recursion).
COMMENT = r"[ \t]*(?:#|//|/?\*+|--|;)[^\n]*"
BLOCK = rf"(?md)^{COMMENT}(?:\n{COMMENT})*+"

#: Texts of short licences, and headers of long ones.
PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

#: Short notices of common licences, then those texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", GNU_HEADER.format(name="Affero General Public License", version=3)),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", APACHE_HEADER),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", TWO_CLAUSES + DISCLAIMER),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", TWO_CLAUSES + THIRD_CLAUSE + DISCLAIMER),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", GNU_HEADER.format(name="General Public License", version=2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", GNU_HEADER.format(name="General Public License", version=3)),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", ISC_TEXT),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", GNU_HEADER.format(name="Lesser General Public License", version=3)),
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT", PERMISSION),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", MPL_HEADER),
}


def template_table(spark: SparkSession, templates: Mapping[str, tuple[str, ...]]) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("license"), F.lit(i).alias("variant"), F.lit(text).alias("text")) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def terms(text: str) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


def score_notices(notices: DataFrame, templates: DataFrame) -> DataFrame:
    """License and cosine of every distinct text of ``notices`` (text, n). Terms
    that most notices have are heavy keys and joined as such."""
    notice = materialize(notices.select("text", "n", F.explode(terms("text")).alias("term")).groupBy("text", "n", "term").agg(F.count("*").alias("tf")), "terms")
    known = templates.select("license", "variant", F.explode(terms("text")).alias("term")).groupBy("license", "variant", "term").agg(F.count("*").alias("tf"))
    both = notice.select("term", "n").unionByName(known.select("term", F.lit(1).cast("long").alias("n")))
    total = notices.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units")).crossJoin(templates.agg(F.count("*").alias("known")))  # a row each
    weights = both.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("rows")).crossJoin(F.broadcast(total))
    weights = materialize(weights.select("term", "rows", (F.log((F.col("units") + F.col("known") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "weights")
    n_rows = weights.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    weighed = join_by_weight(notice, weights, ["term"], "rows", n_rows).select("text", "term", (F.col("tf") * F.col("idf")).alias("w"))
    model = known.join(weights, "term").select("license", "variant", "term", (F.col("tf") * F.col("idf")).alias("v"))
    size = Window.partitionBy("license", "variant")
    model = model.withColumn("model_norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(size)))
    norms = weighed.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(model), "term").groupBy("text", "license", "variant", "model_norm").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "text").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("model_norm")), 6))
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    return scored.groupBy("text").agg(best).select("text", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path: str) -> Column:
    """The path up to its last slash; null for a null path."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def above(column: str) -> Column:
    """A directory and all those above it, down to the root (empty)."""
    parts = F.filter(F.split(column, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def notices_of(text: str, is_file: Column) -> Column:
    """The notices of a text; null where it has none."""
    cue = lambda x: x.rlike(CUES)
    lines = F.filter(F.split(text, "\n"), cue)
    blocks = F.filter(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), cue)
    whole = F.when(is_file & (F.length(text) > 0), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(cue(F.col(text)) | (is_file & (F.length(text) > 0)), F.array_distinct(F.concat(lines, blocks, whole)))


def scan(files: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """License of every row of ``files`` (key, path, text).

    Returns key, path, license, score, origin (``own``, ``inherited`` or
    ``none``) and the path that the license comes from.
    """
    spark = files.sparkSession
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    rows = materialize(files.select(F.monotonically_increasing_id().alias("row"), "key", "path", directory("path").alias("dir"), notices_of("text", is_file).alias("notices")), "files")
    found = rows.where("notices IS NOT NULL").select("row", "path", "dir", F.explode("notices").alias("text"))
    notices = materialize(found.groupBy("text").agg(F.count("*").alias("n")), "notices")
    scored = score_notices(notices, template_table(spark, templates)).where(F.col("score") >= threshold).join(notices, "text")
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    own = join_by_weight(found, materialize(scored, "scored"), ["text"], "n", notices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).groupBy("row", "path", "dir").agg(best)
    own = materialize(own.select("row", "path", "dir", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "own")
    heads = own.where(F.col("path").rlike(LICENCE_FILE)).groupBy("dir").agg(F.min(F.struct("path", "license", "score")).alias("h"))
    dirs = rows.where("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n"))
    ways = dirs.select("dir", F.explode(above("dir")).alias("up"))
    below = materialize(ways.groupBy("up").agg(F.count("*").alias("below")), "below")  # the root is above all
    heads = heads.withColumnRenamed("dir", "up").join(below, "up")
    nearest = F.max(F.struct(F.length("up").alias("depth"), "h")).alias("m")
    given = join_by_weight(ways, materialize(heads, "heads"), ["up"], "below", below.agg(F.coalesce(F.sum("below"), F.lit(0))).first()[0]).groupBy("dir").agg(nearest)
    given = dirs.join(given, "dir", "left").select("dir", "n", F.col("m.h.license").alias("given"), F.col("m.h.score").alias("given_score"), F.col("m.h.path").alias("given_from"))
    covered = rows.select("row", "key", "path", "dir")
    with_dir = join_by_weight(covered.where("dir IS NOT NULL"), materialize(given, "given"), ["dir"], "n", rows.count())
    out = with_dir.unionByName(covered.where("dir IS NULL"), allowMissingColumns=True).join(own.select("row", "license", "score"), "row", "left")
    return out.select(
        "key", "path", F.coalesce("license", "given").alias("license"), F.coalesce("score", "given_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("given_from")).alias("license_path"),
    )
