"""Licence scans: normalised lines against licence templates by the Dice coefficient of their word bigrams.

DataFrame expressions only, and no shuffle: a document's lines are judged in its row.
A line can only reach the threshold t against a template of b bigrams if it has
between b*t/(2-t) and b*(2-t)/t bigrams, and if it shares one of any b - ceil(b*t/(2-t)) + 1
of the template's bigrams; a few words that cover so many bigrams are looked for first.

Passages: a licence that is wrapped over lines, run together in one, or stands inside a
sentence is sought in windows of words over the whole text, against the notices and BODIES.
A window that reaches t holds `lo` of the template's bigrams; texts with fewer are left out.
The best window starts and ends with one of them, so only those windows of at most `span`
bigrams are compared. A text of BODIES is named before any notice; a notice in a passage only
where no line reaches t. Of equal dice, the longer template is named, then the last by name. n_lines counts lines only.

A null or empty text, or one without a line of two words, has no licence (dice 0, n_lines 0).
Ties in dice go to the template that is first by name. Extra columns don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import table

THRESHOLD = 0.8
#: Common one-line licence notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2",
    "GPL-3.0": "Licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_AS_IS = "this list of conditions and the following disclaimer"
_BSD = f"""{TEMPLATES["BSD-notice"]}: 1. Redistributions of source code must retain the above copyright notice, {_AS_IS}.
2. Redistributions in binary form must reproduce the above copyright notice, {_AS_IS} in the documentation and/or other materials provided with the distribution."""
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {}
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
#: Licence texts of several sentences, sought in passages only.
BODIES = {
    "Apache-2.0-text": TEMPLATES["Apache-2.0-notice"]
    + """ You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + _BSD_3 + _BSD_END,
    "GPL-2.0-text": _GPL.format(";", "2"),
    "GPL-3.0-text": _GPL.format(":", "3"),
    "ISC-text": TEMPLATES["ISC"]
    + """, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": TEMPLATES["MIT-notice"]
    + """ (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def normalise(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]


def bigrams(text: str) -> list[str]:
    w = normalise(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(b: int, t: float) -> tuple[int, int]:
    return math.ceil(b * t / (2 - t) - 1e-9), math.floor(b * (2 - t) / t + 1e-9)


def trigger_words(templates: dict[str, str], t: float) -> list[str]:
    """Words of which every line that reaches the threshold against any template has one."""
    chosen: list[str] = []
    for text in templates.values():
        grams = bigrams(text)
        need = len(grams) - bounds(len(grams), t)[0] + 1
        covered = [g for g in grams if set(g.split()) & set(chosen)]
        while len(covered) < need:
            left = [g for g in grams if g not in covered]
            words = sorted({w for g in left for w in g.split()}, key=lambda w: (-len(w), w))
            pick = max(words, key=lambda w: (len(w) > 3, sum(w in g.split() for g in left), len(w)))
            chosen.append(pick)
            covered = [g for g in grams if set(g.split()) & set(chosen)]
    return chosen


def neighbours(words: Column) -> Column:
    """The bigrams of a list of words, in order; the list is worked out once."""
    but_one = lambda w, at: F.slice(w, F.lit(at), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.transform(F.array(words), lambda w: F.zip_with(but_one(w, 1), but_one(w, 2), lambda a, b: F.concat(a, F.lit(" "), b)))[0]


def line_match(line: Column, templates: dict[str, str], t: float) -> Column:
    """The best (dice, name) of one normalised line, null below the threshold or outside every size bound."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    grams = F.array_distinct(neighbours(words))
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.lit(g) for g in bigrams(v)]).alias("grams"), F.lit(bounds(len(bigrams(v)), t)[0]).alias("lo"), F.lit(bounds(len(bigrams(v)), t)[1]).alias("hi")) for k, v in sorted(templates.items())])
    return F.transform(F.array(grams), lambda g: F.transform(F.filter(known, lambda k: F.size(g).between(k["lo"], k["hi"])), lambda k: F.struct((2.0 * F.size(F.array_intersect(g, k["grams"])) / (F.size(g) + F.size(k["grams"]))).alias("dice"), k["name"].alias("name"))))[0]


def passage_match(text: Column, notices: dict[str, str], bodies: dict[str, str], t: float) -> Column:
    """The best (body, dice, size, name) over all windows of words of the text and all templates, bodies first, null below the threshold; line breaks don't count."""
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pairs = neighbours(words)
    known = F.array(
        *[
            F.struct(F.lit(k).alias("name"), F.lit(k in bodies).alias("body"), F.array(*[F.lit(g) for g in bigrams(v)]).alias("grams"), F.lit(bounds(len(bigrams(v)), t)[0]).alias("lo"), F.lit(bounds(len(normalise(v)) - 1, t)[1]).alias("span"))
            for k, v in sorted((notices | bodies).items())
        ]
    )

    def ends(g: Column, k: Column, at: Column, i: Column) -> Column:
        """Dice of the windows that start at the i-th of the template's bigrams in the text."""
        first = F.get(at, i)
        last = F.filter(F.slice(at, i + k["lo"], k["span"]), lambda e: e - first < k["span"])
        window = lambda e: F.array_distinct(F.slice(g, first + 1, e - first + 1))
        return F.transform(last, lambda e: F.transform(F.array(window(e)), lambda x: 2.0 * F.size(F.array_intersect(x, k["grams"])) / (F.size(x) + F.size(k["grams"])))[0])

    def best(g: Column, k: Column) -> Column:
        at = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(k["grams"], x), i)), lambda i: i.isNotNull())
        dice = F.transform(F.array(at), lambda at: F.array_max(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - k["lo"]), lambda i: ends(g, k, at, i)))))[0]
        return F.struct(k["body"].alias("body"), dice.alias("dice"), F.size(k["grams"]).alias("size"), k["name"].alias("name"))

    def all_best(g: Column) -> Column:
        near = lambda d: F.filter(known, lambda k: F.size(F.array_intersect(d, k["grams"])) >= k["lo"])
        return F.filter(F.transform(F.transform(F.array(F.array_distinct(g)), near)[0], lambda k: best(g, k)), lambda m: m["dice"] >= t)

    found = F.transform(F.array(pairs), all_best)[0]
    return F.array_max(found)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", bodies: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, license, dice, n_lines (lines that match some template).

    bodies: given, these and the templates are sought in windows of words, too.
    """
    sizes = [bounds(len(bigrams(v)), threshold) for v in templates.values()]
    trigger = r"\b(?:" + "|".join(map(re.escape, trigger_words(templates, threshold))) + r")\b"
    text = F.regexp_replace(F.lower("text"), "[^a-z0-9\n]+", " ")
    # a line of n distinct bigrams has more than n words; repeats may make it longer, so only the lower bound is safe here
    likely = F.filter(F.split(text, "\n"), lambda x: x.rlike(trigger) & (F.length(x) > 2 * min(lo for lo, _ in sizes)))
    found = F.when(F.lower("text").rlike(trigger.replace(r"\b", "")), F.filter(F.flatten(F.transform(likely, lambda x: F.array(F.sort_array(F.filter(line_match(x, templates, threshold), lambda m: m["dice"] >= threshold), False)))), lambda m: F.size(m) > 0))
    passage = F.lit(None).cast("struct<body:boolean,dice:double,size:int,name:string>")
    if bodies is not None:
        words = "|".join(map(re.escape, trigger_words(templates | bodies, threshold)))
        passage = F.when(F.lower("text").rlike(words), passage_match(F.lower("text"), templates, bodies, threshold))
    picked = docs.select(F.col(key).alias("doc_id"), passage.alias("passage"), F.coalesce(found, F.array().cast("array<array<struct<dice:double,name:string>>>")).alias("found"))
    best = F.array_max(F.transform(F.flatten("found"), lambda m: m["dice"]))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten("found"), lambda m: m["dice"] == best), lambda m: m["name"])))
    wider = F.col("passage").isNotNull() & (F.col("passage.body") | best.isNull())
    return picked.select("doc_id", F.when(wider, F.col("passage.name")).otherwise(F.get(names, F.lit(0))).alias("license"), F.when(wider, F.col("passage.dice")).otherwise(F.coalesce(best, F.lit(0.0))).alias("dice"), F.size("found").cast("long").alias("n_lines"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), bodies=BODIES)


def _sql() -> str:
    rows = ", ".join("('{}', [{}], {}, {})".format(k, ", ".join(f"'{g}'" for g in bigrams(v)), *bounds(len(bigrams(v)), THRESHOLD)) for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH templates(name, grams, lo, hi) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10))) AS line FROM docs),
words AS (SELECT r, list_filter(string_split(line, ' '), lambda w: w <> '') AS w FROM lines),
grams AS (SELECT r, row_number() OVER () AS l, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2),
scored AS (SELECT r, l, name, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams JOIN templates ON len(g) BETWEEN lo AND hi),
good AS (SELECT r, l, name, CAST(dice AS DOUBLE) AS dice FROM scored WHERE dice >= {THRESHOLD}),
best AS (SELECT r, max(dice) AS dice, count(DISTINCT l) AS n_lines FROM good GROUP BY r),
named AS (SELECT r, min(name) AS license FROM good JOIN best USING (r, dice) GROUP BY r)
SELECT doc_id, license, coalesce(dice, CAST(0 AS DOUBLE)) AS dice, coalesce(n_lines, 0) AS n_lines FROM docs LEFT JOIN best USING (r) LEFT JOIN named USING (r)
"""


SQL = _sql()
