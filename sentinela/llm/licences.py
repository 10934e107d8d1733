"""Canonical digest lookup of licence texts.

A text, each of its paragraphs and lines, and each run of paragraphs that starts as a
known text does and has as many as it, is normalised (case,
punctuation, copyright lines, equivalent spellings, white space) and its SHA-256
is joined to the digests of known licence texts and notices. Only entire units
match: a licence name inside a sentence is no hit. The digest table is as long
as the list of known texts, so it may be broadcast; texts aren't shuffled, only
the hits are grouped. A caller's table is broadcast only if it is counted to be short.

Defined results: null and empty texts have no hit; a unit that is only copyright
lines is empty and never matches; rows that share an id, or have none, get the hits of their own
text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm.common import documents, few_joined

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Known licence texts and notices. A licence may have several forms.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("ISC", _ISC_BODY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
)

#: Long texts, as (licence, digest, first paragraph in normal form, paragraphs). Those that
#: end with instructions for use come without them as well.
LONG: tuple[tuple[str, str, str, int], ...] = (
    ("Apache-2.0", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9", "apache license version 2 0 january 2004 http www apache org licenses", 34),
    ("Apache-2.0", "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793", "apache license version 2 0 january 2004 http www apache org licenses", 29),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "gnu general public license version 2 june 1991", 60),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", "gnu general public license version 2 june 1991", 45),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f", "gnu general public license version 3 29 june 2007", 124),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b", "gnu general public license version 3 29 june 2007", 111),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3", "gnu library general public license version 2 june 1991", 86),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c", "gnu library general public license version 2 june 1991", 74),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345", "gnu lesser general public license version 2 1 february 1999", 88),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c", "gnu lesser general public license version 2 1 february 1999", 76),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu lesser general public license version 3 29 june 2007", 37),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", "mozilla public license version 1 1", 73),
    ("MPL-2.0", "522ffc6ac495c6e61524b4b97893c98f63d86e482e6a0878ba2b43f88f326aae", "mozilla public license version 2 0", 83),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "creative commons legal code", 13),
)

#: Steps of the normal form after lower-casing: (pattern, replacement), in order.
#: The patterns mean the same in Java, RE2 and Python.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$", ""),
    (r"&", " and "),
    (r"licence", "license"),
    (r"sub[ -]license", "sublicense"),
    (r"non[ -]?infringement", "noninfringement"),
    (r"copyright owner", "copyright holder"),
    (r"https://", "http://"),
    (r"\b(version|v)[ .]*([0-9])", "version ${2}"),
    (r"[^\pL\pN\n]+", " "),
    (r"(?m)^ +| +$", ""),
)


#: Every known text has one of these letter sequences in any of its spellings, so a
#: text without them can't hold one. ``None`` for other tables of digests.
ANCHORS: tuple[str, ...] = ("licen", "software")


def _py_lines(text: str) -> str:
    text = text.lower()
    for pattern, new in STEPS:
        if r"\pL" in pattern:
            text = re.sub(r"(?:[^\w\n]|_)+", new, text)
        else:
            text = re.sub(pattern, new.replace("${2}", r"\2"), text)
    return text


def _py(text: str) -> str:
    return " ".join(_py_lines(text).split())


def _entry(text: str) -> tuple[str, str, int]:
    """(digest, first paragraph, paragraphs) of a text."""
    blocks = [" ".join(x.split()) for x in re.split(r"\n\n+", _py_lines(text)) if x.strip()]
    return hashlib.sha256(_py(text).encode()).hexdigest(), blocks[0], len(blocks)


def digests() -> list[tuple[str, str]]:
    """(digest, licence id) of the known texts."""
    for _, t in KNOWN:
        if not any(a in t.lower() for a in ANCHORS):
            raise ValueError(f"no anchor in {t[:40]!r}")
    return sorted({(hashlib.sha256(_py(t).encode()).hexdigest(), name) for name, t in KNOWN} | {(x[1], x[0]) for x in LONG})


def starts() -> dict[str, list[int]]:
    """Numbers of paragraphs of the known texts of several, by their first paragraph."""
    out: dict[str, set[int]] = {}
    for first, n in [_entry(t)[1:] for _, t in KNOWN] + [x[2:] for x in LONG]:
        if n > 1:
            out.setdefault(first, set()).add(n)
    return {first: sorted(n) for first, n in sorted(out.items())}


def normal_lines(text: Column) -> Column:
    """The normal form with its line breaks."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern.replace(r"\b", r"(?<![a-z0-9_])"), new.replace("${2}", "$2"))
    return out


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each input row: id, licences (sorted, comma-joined), n_hits, whole
    (the licence that the entire text is, if any)."""
    spark = docs.sparkSession
    begin = starts() if known is None else {}
    if known is None:
        known, anchors = spark.createDataFrame(digests(), "digest string, licence string"), ANCHORS
    flat = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    n = normal_lines(F.col(text_col))
    if anchors:
        low = F.lower(F.col(text_col))
        may = F.lit(False)
        for a in anchors:
            may = may | F.contains(low, F.lit(a))
        n = F.when(may, n).otherwise("")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), n.alias("n"))
    lines = F.transform(F.split("n", "\n"), lambda x: F.struct(F.lit("line").alias("unit"), x.alias("t")))
    blocks = F.transform(F.split("n", r"\n\n+"), lambda x: F.struct(F.lit("paragraph").alias("unit"), flat(x).alias("t")))
    whole = F.array(F.struct(F.lit("text").alias("unit"), flat(F.col("n")).alias("t")))
    units = F.concat(whole, F.when(F.col("n").contains("\n\n"), blocks).otherwise(F.array().cast("array<struct<unit:string,t:string>>")), lines)
    if begin:
        firsts = list(begin)
        most = F.create_map(*[x for k in firsts for x in (F.lit(k), F.array(*map(F.lit, begin[k])))])
        full = F.filter(F.transform(F.split("n", r"\n\n+"), flat), lambda x: x != "")
        base = base.withColumn("b", F.when(F.col("n").contains("\n\n"), full).otherwise(F.array().cast("array<string>")))
        at = F.filter(F.transform("b", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: x["x"].isin(firsts))
        run = lambda x, k: F.struct(F.lit("run").alias("unit"), F.array_join(F.slice("b", x["i"] + 1, k), " ").alias("t"))
        runs = F.transform(at, lambda x: F.transform(F.filter(F.try_element_at(most, x["x"]), lambda k: x["i"] + k <= F.size("b")), lambda k: run(x, k)))
        units = F.concat(units, F.flatten(runs))
    exploded = base.select("id", "th", F.posexplode(units).alias("at", "u")).where("u.t <> ''")
    keyed = exploded.select("id", "th", "at", "u.unit", F.sha2(F.col("u.t").cast("binary"), 256).alias("digest"))
    hits = (
        few_joined(keyed, known, "digest").dropDuplicates(["id", "th", "at", "licence"])  # rows repeated whole count once
        .groupBy("id", "th")
        .agg(
            F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
            F.count(F.when(F.col("unit") == "line", 1)).alias("n_hits"),
            F.min(F.when(F.col("unit") == "text", F.col("licence"))).alias("whole"),
        )
        .withColumnsRenamed({"id": "hit_id", "th": "hit_th"})
    )
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    return ids.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left").select(
        F.col("id").alias(id_col),
        F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"),
        "whole",
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    n = "lower(coalesce(text, ''))"
    for pattern, new in STEPS:
        n = f"regexp_replace({n}, '{pattern}', '{new.replace('${2}', chr(92) + '2')}', 'g')"
    values = ", ".join(f"('{d}', '{name}')" for d, name in digests())
    return rf"""
WITH known(digest, licence) AS (VALUES {values}),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
n AS (SELECT row, {n} AS n FROM d),
u AS (
  SELECT row, 'text' AS unit, n AS t FROM n
  UNION ALL SELECT row, 'line', unnest(string_split(n, chr(10))) FROM n
  UNION ALL SELECT row, 'paragraph', unnest(regexp_split_to_array(n, '\n\n+')) FROM n WHERE contains(n, chr(10) || chr(10))
),
h AS (
  SELECT row, unit, licence
  FROM (SELECT row, unit, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM u) JOIN known ON sha256(t) = digest
)
SELECT d.doc_id, coalesce(string_agg(DISTINCT h.licence, ',' ORDER BY h.licence), '') AS licences,
       count(*) FILTER (WHERE h.unit = 'line') AS n_hits, min(CASE WHEN h.unit = 'text' THEN h.licence END) AS whole
FROM d LEFT JOIN h ON d.row = h.row GROUP BY d.row, d.doc_id
"""


ORACLE = _oracle()
