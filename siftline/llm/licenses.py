"""License scans by canonical digests. DataFrame functions only.

A text is cut at blank lines into paragraphs, and each is put into canonical
form: lower case, copyright lines and title lines left out, equivalent
spellings made one, every run of punctuation and white space one space.
Digests of the paragraphs of a whole text, joined, are hash-joined to those of
known texts. So are single lines that begin as a known text does, and runs of
paragraphs: a paragraph that is a known text's first one leads to the digest of
as many paragraphs as that text has, so a license inside a longer text is found
however its lines are broken.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import doc_texts

# Notices and short license texts as their owners publish them.
KNOWN_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)

#: Equivalent spellings, as (pattern, replacement) over lower-case text. RE2 and Java read them alike.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("(^|\n)[ \t]*(copyright[ \t]*(©|[(]c[)]|[0-9]{4}|[<\\[])|(©|[(]c[)])[ \t]*[0-9]{4})[^\n]*", "$1"),
    ("(^|\n)[ \t]*all rights reserved[. \t]*(\n|$)", "$1"),
    ("^\\s*(the )?(mit|isc|zlib|unlicense|boost software|(new |simplified |modified )?bsd|bsd [0-9]-clause|apache|mozilla public|gnu ([a-z]+ )?general public)( [0-9]-clause)? licen[cs]e[^\n]{0,30}(\n|$)", ""),
    ("licenc", "licens"),
    ("https?://", " "),
    ("[^\\p{L}\\p{N}]+", " "),
    (" (v|ver|version) ([0-9])", " version $2"),
    (" v([0-9])", " version $1"),
)
#: How the first word of a canonical text may be spelt before.
FIRST_SPELT = (("licens", "licen[cs]"), ("^version$", "v(er(sion)?)?"))
PARAGRAPHS = "\\n[ \\t\\r]*\\n"


def canonical(text: Column) -> Column:
    """The canonical form of a paragraph or line."""
    out = reduce(lambda t, rule: F.regexp_replace(t, *rule), SPELLINGS, F.lower(text))
    return F.trim(out)


def paragraphs(text: Column) -> Column:
    """Canonical paragraphs, without those of which nothing is left."""
    return F.filter(F.transform(F.split(text, PARAGRAPHS), canonical), lambda p: p != "")


def _digest(parts: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(parts, " "), 256))


def known_table(texts: DataFrame) -> DataFrame:
    """license_id, digest, lead (digest of the first paragraph), n_paragraphs
    and first_word of known texts ``(license_id, text)``; texts of which
    nothing is left are none."""
    cut = texts.select("license_id", paragraphs(F.coalesce("text", F.lit(""))).alias("p")).filter(F.size("p") > 0)
    first = F.substring_index(F.col("p")[0], " ", 1)
    return cut.select(
        "license_id", _digest(F.col("p")).alias("digest"), _digest(F.slice("p", 1, 1)).alias("lead"), F.size("p").alias("n_paragraphs"), first.alias("first_word")
    ).distinct()


def known_digests(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN_TEXTS) -> DataFrame:
    """``known_table`` of a fixed, small list."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in texts)))
    return known_table(spark.range(1).select(rows.alias("r")).select("r.*"))


def read_known(spark: SparkSession, folder: str) -> DataFrame:
    """``known_table`` of a folder of whole license texts, one file each, named
    ``<license_id>.txt`` or without an ending."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return known_table(files.select(F.regexp_replace("file", r"\.txt$", "").alias("license_id"), "text"))


def line_start(known: DataFrame) -> str:
    """A pattern for lines that may begin as a known text of one paragraph."""
    words = sorted(r[0] for r in known.filter("n_paragraphs = 1").select("first_word").distinct().collect())  # of the known licenses
    spelt = [reduce(lambda w, rule: re.sub(*rule, w), FIRST_SPELT, w) for w in words]
    return rf"(?i)^[^\p{{L}}\p{{N}}]*(https?://)?({'|'.join(spelt)})([^\p{{L}}\p{{N}}]|$)" if spelt else "$^"


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the whole canonical text), whole_license (what the
    whole text is, else null), licenses (sorted ids of all matches, joined by a
    comma; empty without one), matched_lines, matched_runs (runs of two
    paragraphs or more).

    A null text counts as empty. Rows that repeat a doc_id give one row for
    each canonical text among them; where those break their lines differently,
    one of them (the least array of lines) is looked at. An empty table gives
    an empty table; other columns are not looked at. ``known`` is a
    ``known_table`` and is broadcast: it holds the known licenses, not the corpus.
    """
    start = line_start(known)
    text = doc_texts(docs, id_col, text_col).select("doc_id", "text", paragraphs(F.col("text")).alias("p"))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda line: line.rlike(start)), lambda line: F.unhex(F.sha2(canonical(line), 256)))
    longer = known.filter("n_paragraphs > 1").select("lead", "n_paragraphs").distinct()
    leads = F.broadcast(longer.groupBy("lead").agg(F.collect_set("n_paragraphs").alias("spans")).agg(F.map_from_entries(F.collect_list(F.struct(F.hex("lead").alias("lead"), "spans"))).alias("leads")))
    # One row, a map of the known first paragraphs; documents are not exploded into paragraphs.
    cut = text.crossJoin(leads).select("doc_id", _digest(F.col("p")).alias("digest"), lines.alias("lines"), _runs(F.col("p"), F.col("leads")).alias("runs"))
    cut = cut.groupBy("doc_id", "digest").agg(F.min(F.struct("lines", "runs")).alias("parts"))
    kinds = F.concat(_of_kind("whole", F.array("digest")), _of_kind("line", F.col("parts.lines")), _of_kind("run", F.col("parts.runs")))
    every = cut.select("doc_id", "digest", F.inline(kinds))
    table = F.broadcast(known.select("license_id", F.col("digest").alias("looked_up")).distinct())
    met = every.join(table, "looked_up", "left")
    ids = F.array_join(F.array_sort(F.collect_set("license_id")), ",")
    times = lambda kind: F.count(F.when((F.col("kind") == kind) & F.col("license_id").isNotNull(), 1))
    return met.groupBy("doc_id", "digest").agg(
        F.max(F.when(F.col("kind") == "whole", F.col("license_id"))).alias("whole_license"), ids.alias("licenses"),
        times("line").alias("matched_lines"), times("run").alias("matched_runs"),
    ).withColumn("digest", F.lower(F.hex("digest")))


def _of_kind(kind: str, digests: Column) -> Column:
    return F.transform(digests, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("looked_up")))


def _runs(p: Column, leads: Column) -> Column:
    """Digests of the runs of paragraphs that begin with a known first one, as
    long as the known text is. The whole text is looked up anyway."""
    spans = F.transform(p, lambda x, i: F.transform(
        F.coalesce(F.try_element_at(leads, F.upper(F.sha2(x, 256))), F.array().cast("array<int>")), lambda n: F.struct((i + 1).alias("at"), n.alias("n")),
    ))
    inside = F.filter(F.flatten(spans), lambda r: (r["at"] + r["n"] - 1 <= F.size(p)) & (r["n"] < F.size(p)))
    return F.transform(inside, lambda r: _digest(F.slice(p, r["at"], r["n"])))
