"""Licence notices found by the Dice coefficient of word bigrams.

Lines, paragraphs of several lines, and spans of running text are normalised (lower case, only letters and digits, one space) and compared to licence templates:
2 x common bigrams / (bigrams of both), repeats counted. To reach LEAST, a text must have between LEAST / (2 - LEAST) and (2 - LEAST) / LEAST times as many bigrams
as the template, so most texts meet few templates or none; and it must hold one of a few words without which too few bigrams can be common. Bigrams of what is left are joined to the bigrams of the templates (a small fixed table), and only
those found are counted: DataFrame functions from end to end, and no group is larger than the common bigrams of a notice.

Spans are windows of as many words as the template has, so that a notice is compared wherever it stands. A window need only begin at a bigram of the template. The places of a
template's bigrams are put into cells as wide as the template: a window lies in two neighbouring cells, and those with too few of the bigrams are left at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

LEAST = 0.8


@dataclass(frozen=True)
class Template:
    license: str
    text: str


# Usual notices of public licences.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "Licensed under the MIT License."),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("Proprietary", "All rights reserved."),
    Template("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Clauses and disclaimers of whole licence texts, and further notices.
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    Template("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    Template("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    Template("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("MPL-2.0", "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing."),
    Template("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, str, str, int, int]]:
    """(template, word, next word, count, bigrams of the template); templates of one word have none and never match."""
    out = []
    for k, t in enumerate(templates):
        words = _words(t.text)
        pairs = list(zip(words, words[1:], strict=False))
        out += [(k, a, b, pairs.count((a, b)), len(pairs)) for a, b in sorted(set(pairs))]
    return out


def bounds(n: int, least: float) -> tuple[int, int]:
    """Least and most bigrams of a text that can reach `least` with a template of n."""
    return -int(-(least * n / (2 - least)) // 1), int((2 - least) * n / least + 1e-9)


def anchors(templates: tuple[Template, ...], least: float) -> list[str]:
    """Words without which no text can reach `least`: with all bigrams that hold one of them missing, too few of any template are left.

    If r of a template's n bigrams are left, the coefficient is 2r / (r + n) at most. Long words are taken first, as they are rare elsewhere."""
    chosen: set[str] = set()
    for t in sorted(templates, key=lambda t: len(t.text)):
        words = _words(t.text)
        left = [p for p in zip(words, words[1:], strict=False) if not chosen & set(p)]
        total = len(words) - 1
        while left and len(left) >= least * total / (2 - least) - 1e-9:
            best = max(sorted({w for p in left for w in p}), key=lambda w: (len(w) > 4, sum(w in p for p in left), len(w)))
            chosen.add(best)
            left = [p for p in left if best not in p]
    return sorted(chosen)


def normalised(text: Column) -> Column:
    """Words in lower case with one space between, line breaks kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, unit (line, paragraph or span), unit_no (from 0), template (its number), license, dice: every unit that reaches `least`, with its best template
    (the first of equals).

    Paragraphs are runs between lines without letters and digits, and only those of several lines are units besides their lines. The number of a span is that of its
    first word; of spans that overlap the best is returned (of equals the one with the first template, then the first word), and none of a licence of which a line or
    paragraph of the row is a notice. Null and empty texts hold no unit.
    Repeated rows give repeated rows; null doc_ids come back null.
    """
    spark: SparkSession = docs.sparkSession
    pairs = template_bigrams(templates)
    sizes = {k: n for k, _, _, _, n in pairs}
    limits = {k: bounds(n, least) for k, n in sizes.items()}
    if not pairs:
        return spark.createDataFrame([], "doc_id long, unit string, unit_no int, template int, license string, dice double")
    # a constant of a few hundred rows, whatever the documents
    table = F.broadcast(spark.createDataFrame([(k, a, b, c, n, *limits[k], templates[k].license) for k, a, b, c, n in pairs], "template int, word string, next string, times int, t_size int, low int, high int, license string"))
    smallest, largest = min(low for low, _ in limits.values()), max(high for _, high in limits.values())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of equal doc_id are told apart
    rows = rows.withColumn("which", F.monotonically_increasing_id())
    rows = rows.withColumn("text", normalised(F.col("text")))
    parts = F.array(F.struct(F.lit("line").alias("unit"), F.split("text", "\n").alias("parts")), F.struct(F.lit("paragraph").alias("unit"), F.split("text", "\n\n+").alias("parts")))
    units = rows.select("doc_id", "which", F.inline(parts)).select("doc_id", "which", "unit", F.posexplode("parts").alias("unit_no", "text"))
    units = units.filter((F.col("unit") == "line") | F.col("text").contains("\n")).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    units = units.withColumn("size", F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))))
    units = units.filter(F.col("size").between(smallest, largest)).withColumn("words", F.split("text", " "))
    units = units.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in anchors(templates, least)])))
    pair = F.arrays_zip(F.slice("words", F.lit(1), F.col("size")).alias("word"), F.slice("words", F.lit(2), F.col("size")).alias("next"))
    bigrams = units.select("doc_id", "which", "unit", "unit_no", "size", F.explode(pair).alias("b")).select("doc_id", "which", "unit", "unit_no", "size", F.col("b.word").alias("word"), F.col("b.next").alias("next"))
    met = bigrams.join(table, ["word", "next"]).filter(F.col("size").between(F.col("low"), F.col("high")))
    keys = ["doc_id", "which", "unit", "unit_no", "size", "template", "license", "t_size"]
    common = met.groupBy(*keys, "word", "next", "times").agg(F.count("*").alias("n"))
    total = common.groupBy(*keys).agg(F.sum(F.least("n", "times")).alias("common"))
    reached = total.withColumn("dice", 2.0 * F.col("common") / (F.col("size") + F.col("t_size"))).filter(F.col("dice") >= least)
    best = reached.groupBy("doc_id", "which", "unit", "unit_no").agg(F.max(F.struct("dice", (-F.col("template")).alias("order"), "template", "license")).alias("best"))
    best = stored(best.select("doc_id", "which", "unit", "unit_no", "best.template", "best.license", "best.dice"), "license-units")
    spans = _spans(rows, table, templates, least).join(best.select("which", "license"), ["which", "license"], "left_anti")
    return best.drop("which").unionByName(_best_of_overlapping(spans).select("doc_id", F.lit("span").alias("unit"), "unit_no", "template", "license", "dice"))


def _spans(rows: DataFrame, table: DataFrame, templates: tuple[Template, ...], least: float) -> DataFrame:
    """Windows of normalised texts (doc_id, which, text) that reach `least`: doc_id, which, unit_no (first word), last (last word), template, license, dice."""
    words = rows.select("doc_id", "which", F.split("text", "[ \n]+").alias("words")).filter((F.size("words") > 1) & F.arrays_overlap("words", F.array(*[F.lit(w) for w in anchors(templates, least)])))
    pair = F.arrays_zip(F.slice("words", F.lit(1), F.size("words") - 1).alias("word"), F.slice("words", F.lit(2), F.size("words") - 1).alias("next"))
    bigrams = words.select("doc_id", "which", (F.size("words") - 1).alias("total"), F.posexplode(pair).alias("at", "b")).select("doc_id", "which", "total", "at", F.col("b.word").alias("word"), F.col("b.next").alias("next"))
    met = bigrams.join(table, ["word", "next"]).withColumn("cell", F.floor(F.col("at") / F.col("t_size")).cast("int"))
    met = stored(met.select("doc_id", "which", "total", "at", "cell", "template", "license", "t_size", "times", "word", "next"), "license-bigrams")
    # in two cells, one after the other, a window has room; its size is the template's, less at the end of a text
    from_cells = met.select("which", "template", "t_size", "cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("first"))
    room = from_cells.groupBy("which", "template", "first").agg(F.count("*").alias("n"), F.max("t_size").alias("t_size"))
    room = room.filter(F.col("n") >= least * F.col("t_size") / (2 - least) - 1e-9).select("which", "template", "first")
    starts = met.select("doc_id", "which", "total", "template", "license", "t_size", F.col("at").alias("unit_no"), F.col("cell").alias("first")).join(room, ["which", "template", "first"])
    held = met.select("which", "template", "at", "word", "next", "times", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("first")).join(room, ["which", "template", "first"])
    inside = starts.join(held, ["which", "template", "first"]).filter((F.col("at") >= F.col("unit_no")) & (F.col("at") < F.col("unit_no") + F.col("t_size")))
    keys = ["doc_id", "which", "total", "template", "license", "t_size", "unit_no"]
    common = inside.groupBy(*keys, "word", "next", "times").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(F.least("n", "times")).alias("common"))
    size = F.least(F.col("t_size"), F.col("total") - F.col("unit_no"))
    found = common.withColumn("dice", 2.0 * F.col("common") / (size + F.col("t_size"))).filter(F.col("dice") >= least)
    return found.select("doc_id", "which", F.col("unit_no").cast("int").alias("unit_no"), (F.col("unit_no") + size).cast("int").alias("last"), "template", "license", "dice")


def _best_of_overlapping(spans: DataFrame) -> DataFrame:
    """The spans of which no word lies in a better one. Spans meet in the cells that hold a word of them."""
    spans = stored(spans, "license-spans")
    celled = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("unit_no") / 128), F.floor(F.col("last") / 128))))
    other = celled.select("which", "cell", *[F.col(c).alias(f"_{c}") for c in ("unit_no", "last", "template", "dice")])
    better = F.struct("_dice", -F.col("_template"), -F.col("_unit_no")) > F.struct("dice", -F.col("template"), -F.col("unit_no"))
    worse = celled.join(other, ["which", "cell"]).filter((F.col("_unit_no") <= F.col("last")) & (F.col("unit_no") <= F.col("_last")) & better)
    return spans.join(worse.select("which", "unit_no", "template").distinct(), ["which", "unit_no", "template"], "left_anti")
