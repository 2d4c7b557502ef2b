"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything but
letters and digits as single blanks. The digest of the whole canonical text is joined to the digests of known licence
texts, which are a fixed table (`KNOWN`, a few dozen short entries), so the join is a broadcast of a table of fixed size.
The same lookup for each line finds the notices that stand as a line of their own inside a longer text.

Defined results: null and empty texts, and texts of nothing but copyright lines, match nothing; copies match alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents

#: Known texts, as (licence, text). Fixed values.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: Equivalent spellings, as (pattern, replacement) over canonical words. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("https", "http"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
)
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[^\n]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null for null."""
    out = F.lower(text)
    out = F.regexp_replace(out, _COPYRIGHT, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def known_digests(spark: SparkSession) -> DataFrame:
    """digest and licence of each known text."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    return rows.select(F.md5(canonical(F.col("text")).cast("binary")).alias("digest"), "license").dropDuplicates(["digest"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the licence that the whole text is, and how many lines are a licence notice and of which licences.

    Only lines that can match are hashed: the canonical form of each known text has `license`, `permission`,
    `redistribution` or `software` in it, so a line without any of these (in any spelling) is passed over.
    """
    spark = docs.sparkSession
    known = known_digests(spark)
    digest = F.md5(canonical(F.col("text")).cast("binary"))
    likely = lambda c: c.rlike(r"(?i)licen[cs]e|permission|redistribution|software")
    lines = F.transform(F.filter(F.split("text", "\n"), likely), lambda x: F.md5(canonical(x).cast("binary")))
    table = F.create_map(*(F.lit(x) for r in known.collect() for x in (r["digest"], r["license"])))
    marked = docs.select("doc_id", F.when(likely(F.col("text")), digest).alias("digest"), F.when(likely(F.col("text")), lines).alias("lines"))
    found = F.filter(F.transform("lines", lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())
    whole = marked.join(F.broadcast(known), "digest", "left")
    return whole.select(
        "doc_id",
        F.col("license"),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))), ",").alias("notices"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql_canonical(text: str) -> str:
    out = rf"regexp_replace(lower({text}), '(?m)^[^a-z0-9\n]*(copyright[^\n]*(\(c\)|©|[0-9]{{4}})|\(c\)|©)[^\n]*$', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return rf"""
WITH known AS (
  SELECT md5({_sql_canonical('t')}) AS digest, any_value(license) AS license FROM (VALUES {rows}) v(license, t) GROUP BY 1),
notices AS (
  SELECT row_id, k.license FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS row_id, text, doc_id FROM documents) d
    WHERE regexp_matches(text, '(?i)licen[cs]e|permission|redistribution|software')) l
  JOIN known k ON k.digest = md5({_sql_canonical('line')}) WHERE regexp_matches(line, '(?i)licen[cs]e|permission|redistribution|software')),
found AS (SELECT row_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM notices GROUP BY row_id)
SELECT d.doc_id, k.license, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices, coalesce(f.names, '') AS notices
FROM (SELECT row_number() OVER () AS row_id, text, doc_id FROM documents) d
LEFT JOIN known k ON k.digest = md5({_sql_canonical('d.text')}) LEFT JOIN found f ON f.row_id = d.row_id
"""


OP7_SQL = _sql()
