"""License scan: texts, lines and passages against license templates by the Dice coefficient over word bigrams.

Normalised text (ASCII letters and digits, lower case, single spaces) becomes a set of word bigrams; a unit matches a template
if 2 * shared / (n + m) reaches the threshold. Units are the whole text, each line of it, and spans: passages of the running
text, whatever its line breaks, so that a license wrapped over many lines inside a longer document is found. A match needs
m * t / (2 - t) <= n <= m * (2 - t) / t, which prunes units before their bigrams are spread and templates before
they are counted; and it needs one of a few words that no matching text can avoid, which passes over most documents.

For spans only bigrams that a template holds are spread, with their positions. A template of T words is sought in windows of
T * 6 / 5 words, one every T / 5; the span is what lies between the first and the last of its bigrams in a window, and its size is
counted only where enough of them are shared. Only built-in functions run on the main path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.llm.common import materialize, require

#: Short notices, usual file headers and license texts, as their publishers word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Released under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
        "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
        '1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 '
        'of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. '
        '"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common '
        'control with that entity. For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction '
        "or management of such entity, whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding "
        "shares, or (iii) beneficial ownership of such entity."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsl-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "gpl-2.0-text": (
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is "
        "intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public "
        "License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."
    ),
    "gpl-3.0-text": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other "
        "practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended "
        "to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


#: Words of everyday English, poor probes.
COMMON = frozenset("a all and any are as at be by can for free from in is it its no not of on or other our shall that the their this to under use used was were will with without you your".split())


def normal_words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def bigrams(words: Column) -> Column:
    """Distinct word bigrams; none below two words."""
    return once(words, _bigrams)


def _bigrams(words: Column) -> Column:
    both = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, m, words, bigram): of fixed size, whatever the corpus."""
    rows = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, body string")
    rows = rows.withColumn("w", normal_words(F.col("body"))).select("license", F.size("w").alias("words"), bigrams(F.col("w")).alias("b"))
    return rows.select("license", F.size("b").alias("m"), "words", F.explode("b").alias("bigram"))


def probe_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every matching text holds at least one.

    A match shares at least m * t / (2 - t) of a template's m bigrams, so it cannot avoid words that cover more
    bigrams than the rest. Long words are taken first, as they are rarer in other texts.
    """
    open_ = {}
    for name, text in templates.items():
        pairs = set(_python_bigrams(text))
        open_[name] = [pairs, len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1]
    chosen: list[str] = []
    while open_ := {k: v for k, v in open_.items() if v[0] and v[1] > 0}:
        gain: Counter[str] = Counter()
        for pairs, _ in open_.values():
            gain.update(w for p in pairs for w in set(p))
        word = max(gain, key=lambda w: (w not in COMMON, not w.isdigit(), min(len(w), 6), gain[w], w))
        chosen.append(word)
        open_ = {k: [{p for p in pairs if word not in p}, need - sum(word in p for p in pairs)] for k, (pairs, need) in open_.items()}
    return chosen


def _holds(low: Column, word: str) -> Column:
    """The lower-case text holds the word; a short one as a whole word, as it stands inside too many others."""
    return F.contains(low, F.lit(word)) if len(word) > 4 else F.rlike(low, F.lit(f"(?<![a-z0-9]){word}(?![a-z0-9])"))


def _units(rows: DataFrame, table: DataFrame, sizes: list[int], t: float) -> DataFrame:
    """Lines and whole texts of (doc_id, row, text) that match."""
    least, most = min(sizes) * t / (2 - t), max(sizes) * (2 - t) / t
    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), F.col("text").alias("line")))).otherwise(F.array())
    each = F.transform(lines, lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), x.alias("line")))
    units = (
        rows.select("doc_id", "row", F.explode(F.concat(whole, each)).alias("u"))
        .select("doc_id", "row", "u.unit", "u.place", bigrams(normal_words(F.col("u.line"))).alias("b"))
        .select("doc_id", "row", "unit", "place", F.explode(F.when(F.size("b").between(least, most), F.array("b"))).alias("b"))
        .withColumn("n", F.size("b"))
    )
    spread = units.select("doc_id", "row", "unit", "place", "n", F.explode("b").alias("bigram"))
    fits = (F.col("n") >= F.col("m") * (t / (2 - t)) - 1e-9) & (F.col("n") <= F.col("m") * ((2 - t) / t) + 1e-9)
    shared = spread.join(table, "bigram").where(fits).groupBy("doc_id", "row", "unit", "place", "license", "n", "m").agg(F.count("*").alias("shared"))
    return shared.withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("m"))).where(F.col("dice") >= t)


def _pairs_in_order(words: Column) -> Column:
    return F.when(
        F.size(words) > 1,
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.array().cast("array<string>"))


def _spans(rows: DataFrame, table: DataFrame, t: float) -> DataFrame:
    """Spans of (doc_id, row, text) that match; ``place`` is the number of the span's first word."""
    hits = rows.select("row", F.posexplode(once(normal_words(F.col("text")), _pairs_in_order)).alias("p", "bigram")).join(table, "bigram")
    step = F.greatest(F.lit(1), F.floor(F.col("words") / 5)).cast("int")
    # window k holds the bigrams that begin at k * step ... k * step + words + step - 2; hits in up to (words + step - 1) / step + 1 windows
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - F.col("words") - F.col("step") + 2) / F.col("step"))).cast("int")
    windows = hits.withColumn("step", step).withColumn("k", F.explode(F.sequence(first, F.floor(F.col("p") / F.col("step")).cast("int"))))
    grouped = windows.groupBy("row", "license", "m", "k").agg(F.countDistinct("bigram").alias("shared"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    enough = grouped.where(F.col("shared") >= F.col("m") * (t / (2 - t)) - 1e-9).select("row", "license", "m", "shared", "lo", "hi").distinct()
    sized = enough.join(rows.select("doc_id", "row", "text"), "row").select(
        "doc_id", "row", F.lit("span").alias("unit"), F.col("lo").alias("place"), "license", "m", "shared",
        F.size(F.array_distinct(F.slice(_pairs_in_order(normal_words(F.col("text"))), F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))).alias("n"),
    )
    return sized.withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("m"))).where(F.col("dice") >= t)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """documents -> every matching (unit, template): doc_id, row, unit, place, license, shared, n, m, dice.

    unit is line (``place`` its number from 0), text (the whole text where it has two lines or more) or span (``place`` its first
    word). Null and empty texts and units below two words match nothing; ``row`` numbers the rows, so equal rows match each; an empty
    table gives an empty result; further columns are ignored.
    """
    spark, t, templates = docs.sparkSession, threshold, templates or TEMPLATES
    table = F.broadcast(template_table(spark, templates))
    sizes = [len(set(_python_bigrams(x))) for x in templates.values()]
    words = sorted(probe_words(templates, t), key=len, reverse=True)
    maybe = F.exists(F.array(F.lower("text")), lambda low: reduce(or_, [_holds(low, w) for w in words]))
    # texts are read and probed once; what is left is read by lines, spans and the spans' sizes
    rows = materialize(require(docs, "doc_id", "text").where(maybe).withColumn("row", F.monotonically_increasing_id()))
    columns = ["doc_id", "row", "unit", "place", "license", "shared", "n", "m", "dice"]
    return _units(rows, table, sizes, t).select(columns).union(_spans(rows, table, t).select(columns))


def _python_bigrams(text: str) -> list[tuple[str, str]]:
    """Sizes of the templates, which are constants of this module or an argument."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split()
    return list(zip(words, words[1:], strict=False))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, unit, place, license, dice: where each license stands best in each row.

    Of a unit only the best template counts (ties: the first name), and of a license's units in a row the best (ties: a line
    before a span before the whole text, then the first).
    """
    best = F.min_by(F.struct("license", "dice"), F.struct(-F.col("dice"), F.col("license")))
    units = license_matches(docs, templates, threshold).groupBy("doc_id", "row", "unit", "place").agg(best.alias("x")).select("doc_id", "row", "unit", "place", "x.license", "x.dice")
    place = F.min_by(F.struct("unit", "place", "dice"), F.struct(-F.col("dice"), F.col("unit"), F.col("place")))
    return units.groupBy("doc_id", "row", "license").agg(place.alias("p")).select("doc_id", "p.unit", "p.place", "license", "p.dice")


def oracle(threshold: float = 0.8) -> str:
    """The same scan as DuckDB SQL, without probe words."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    norm = "string_split(trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    every = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    return f"""
WITH t AS (SELECT license, {norm.format('body')} AS words FROM (VALUES {values}) v(license, body)),
tb AS (SELECT license, len(words) AS nw, list_distinct({every}) AS b FROM t),
te AS (SELECT license, len(b) AS m, nw, unnest(b) AS bigram FROM tb),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'line' AS unit, i - 1 AS place, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
      UNION ALL SELECT doc_id, 'text', 0, text FROM l WHERE len(ls) > 1),
w AS (SELECT doc_id, unit, place, {norm.format('line')} AS words FROM u),
ub AS (SELECT doc_id, unit, place, list_distinct({every}) AS b FROM w WHERE len(words) > 1),
ue AS (SELECT doc_id, unit, place, len(b) AS n, unnest(b) AS bigram FROM ub),
s AS (SELECT doc_id, unit, place, license, n, m, count(*) AS shared FROM ue JOIN te USING (bigram) GROUP BY ALL),
dw AS (SELECT doc_id, {norm.format('text')} AS words FROM l),
db AS (SELECT doc_id, {every} AS bs FROM dw WHERE len(words) > 1),
dp AS (SELECT doc_id, i - 1 AS p, bs[i] AS bigram FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM db)),
h AS (SELECT doc_id, p, bigram, license, m, nw, greatest(1, nw // 5) AS step FROM dp JOIN te USING (bigram)),
k AS (SELECT *, unnest(range(CAST(greatest(0, ceil((p - nw - step + 2) / step)) AS BIGINT), p // step + 1)) AS k FROM h),
g AS (SELECT doc_id, license, m, k, count(DISTINCT bigram) AS shared, min(p) AS lo, max(p) AS hi FROM k GROUP BY ALL),
e AS (SELECT DISTINCT doc_id, license, m, shared, lo, hi FROM g WHERE shared >= m * {threshold} / (2 - {threshold}) - 1e-9),
z AS (SELECT doc_id, 'span' AS unit, lo AS place, license, len(list_distinct(bs[lo + 1:hi + 1])) AS n, m, shared FROM e JOIN db USING (doc_id)),
d AS (SELECT doc_id, unit, place, license, 2.0 * shared / (n + m) AS dice FROM (SELECT * FROM s UNION ALL BY NAME SELECT * FROM z)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) AS k FROM d WHERE dice >= {threshold}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, unit, place) AS q FROM r WHERE k = 1)
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, CAST(dice AS DOUBLE) AS dice FROM o WHERE q = 1
"""
