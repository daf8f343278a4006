"""Licence texts found by canonical digest, in DataFrame operations only.

Case, punctuation, copyright lines and equivalent spellings are normalised; the digest of what is left is looked up by a
hash join in the table of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.line_rules import bound
from ledgerline.session import stage

# Public licence texts and notices.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may
be used to endorse or promote products derived from this software without specific
prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
LICENCES = [
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
     "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
     "granted.\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_2 + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_2 + _BSD_NAMES + _BSD_WARRANTY),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Spellings that licence matching treats as equal, the second taken for the first.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https://", "http://"),
    ("©", "(c)"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PUNCTUATION = "[^a-z0-9\\n\\x{80}-\\x{10FFFF}]+"
#: A line that begins so, in normal form, and names a year or the sign.
_COPYRIGHT = "^(copyright c |c copyright |c [0-9]{4}|copyright [0-9]{4}|copyright .* [0-9]{4}( |$))"


def canonical_lines(text: Column) -> Column:
    """The text's lines in normal form, without empty and copyright lines."""
    normal = F.translate(text, _UPPER, _LOWER)
    for spelling, standard in SPELLINGS:
        normal = F.replace(normal, F.lit(spelling), F.lit(standard))
    normal = F.regexp_replace(normal, _PUNCTUATION, " ")
    lines = F.transform(F.split(normal, "\n", -1), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(_COPYRIGHT))


def known_digests(spark, licences: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id) of the canonical texts; two ids for one text are an error of the table."""
    known = spark.createDataFrame(licences, "license_id string, text string")
    return known.select(F.md5(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"), "license_id").distinct()


def scan_licences(docs: DataFrame, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, digest of the canonical text, license_id when the entire text is a known
    licence, and notices, the sorted ids of the known licences that entire lines of the text state, joined by commas.

    Defined cases: a null or empty text has the digest of no words, no licence and no notices; null doc_ids and repeated
    rows stay; other columns are ignored; no rows give no rows. The table of licences is a short list given in code (an
    error above 10,000 entries), so it is broadcast. Texts are read once and never shuffled: their digests are staged.
    """
    licences = LICENCES if licences is None else licences
    if len(licences) > 10_000:
        raise ValueError("a longer table of licences belongs in a file and a join by key")
    known = F.broadcast(known_digests(docs.sparkSession, licences))
    digests = stage(
        docs.select(
            "doc_id",
            bound(
                canonical_lines(F.coalesce(F.col("text"), F.lit(""))),
                lambda lines: F.struct(
                    F.md5(F.array_join(lines, " ")).alias("digest"),
                    F.array_distinct(F.transform(lines, lambda line: F.md5(line))).alias("line_digests"),
                ),
            ).alias("_d"),
        ).select("doc_id", "_d.digest", "_d.line_digests"),
        "licence-digests",
    )
    notices = (
        digests.select("doc_id", F.col("digest").alias("whole"), F.explode("line_digests").alias("digest"))
        .join(known, "digest")
        .groupBy("doc_id", "whole")
        .agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    )
    rows = digests.select("doc_id", "digest").join(known, "digest", "left").alias("r")
    same = (F.col("r.digest") == F.col("n.whole")) & F.col("r.doc_id").eqNullSafe(F.col("n.doc_id"))
    return rows.join(notices.alias("n"), same, "left").select(
        "r.doc_id", "r.digest", "r.license_id", F.coalesce("n.notices", F.lit("")).alias("notices")
    )


def scan_sql(licences: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL for the rows of :func:`scan_licences` over ``documents``."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def lines(text: str) -> str:
        normal = f"translate({text}, '{_UPPER}', '{_LOWER}')"
        for spelling, standard in SPELLINGS:
            normal = f"replace({normal}, {quoted(spelling)}, {quoted(standard)})"
        normal = f"regexp_replace({normal}, {quoted(_PUNCTUATION)}, ' ', 'g')"
        trimmed = f"list_transform(string_split({normal}, chr(10)), lambda x: trim(x, ' '))"
        return f"list_filter({trimmed}, lambda x: x <> '' AND NOT regexp_matches(x, {quoted(_COPYRIGHT)}))"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in (LICENCES if licences is None else licences))
    return f"""
        WITH known AS (
          SELECT DISTINCT md5(array_to_string(l, ' ')) AS digest, license_id
          FROM (SELECT license_id, {lines('text')} AS l FROM (VALUES {values}) AS v(license_id, text))
        ), rows_ AS (
          SELECT row_number() OVER () AS r, doc_id, md5(array_to_string(l, ' ')) AS digest, l
          FROM (SELECT doc_id, {lines("coalesce(text, '')")} AS l FROM documents)
        ), found AS (
          SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
          FROM (SELECT r, md5(unnest(l)) AS digest FROM rows_) JOIN known USING (digest) GROUP BY r
        )
        SELECT doc_id, rows_.digest AS digest, license_id, coalesce(notices, '') AS notices
        FROM rows_ LEFT JOIN known ON rows_.digest = known.digest LEFT JOIN found USING (r)
    """
