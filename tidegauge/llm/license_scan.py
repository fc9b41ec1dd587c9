"""Licence scans: canonical digests of entire texts, looked up among the digests of known licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, free_name, lower_ascii, small_side

# Fixed values: (identifier, text) of known licences and of the one-line notices that stand for them.
LICENSES = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
]

# SHA-256 of the canonical form of entire licences that are too long to quote (the FSF's, ASF's, Mozilla's and CC's plain texts).
WHOLE_TEXTS = [
    ("Apache-2.0", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3-only", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "312d60d6637eaa5485742576ef2bf899e0513899a4e98cc9a1a6c688423c3ca6"),
    ("MPL-2.0", "92e88af3b436afcb6eef8128c9d1a7b2c6312377163ae31dfbacec094f33ab64"),
]

# Lines that name a copyright holder or reserve rights; they are dropped.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|<year>|\[yyyy\])|\(c\)[ \t]+|©|all rights reserved\.?[ \t]*$)[^\n]*$"
# Runs of ASCII marks, Latin-1 marks and typographic punctuation count as one space.
MARKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\u00A0-\u00A9\u00AB-\u00B1\u00B4\u00B6-\u00B8\u00BB\u00BF\u2010-\u2027\u2030-\u205E]+"
# Equivalent spellings, replaced in this order after marks are gone.
SPELLINGS = [
    ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("authoris", "authoriz"), ("customis", "customiz"), ("initialis", "initializ"), ("organis", "organiz"), ("recognis", "recogniz"),
    ("normalis", "normaliz"), ("summaris", "summariz"), ("utilis", "utiliz"), ("realis", "realiz"), ("minimis", "minimiz"), ("maximis", "maximiz"),
    ("colour", "color"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("behaviour", "behavior"),
    ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("non infring", "noninfring"),
    ("copyright owner", "copyright holder"), ("https ", "http "), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("per cent", "percent"),
]


def canonical(text: Column) -> Column:
    """text with A-Z lower-cased, without copyright lines, marks as spaces, spellings made equal. Null counts as empty."""
    out = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, MARKS, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def license_table(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, license_digest, notice) of known licences; a digest that several texts share keeps the smallest identifier.

    Without an own list these are LICENSES and WHOLE_TEXTS; the SQL has LICENSES only."""
    rows = spark.createDataFrame(LICENSES if licenses is None else licenses, "license_id string, text string")
    whole = rows.select("license_id", canonical(F.col("text")).alias("c"), (~F.trim(F.col("text")).contains("\n")).alias("notice"))
    known = whole.select(F.sha2("c", 256).alias("license_digest"), "license_id", "notice")
    if licenses is None:
        known = known.union(spark.createDataFrame([(d, i, False) for i, d in WHOLE_TEXTS], known.schema))
    return known.groupBy("license_digest").agg(F.min("license_id").alias("license_id"), F.bool_or("notice").alias("notice"))


def license_scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_notices: int = 10_000) -> DataFrame:
    """For each row: canonical_digest of its entire text, the license_id whose digest equals it (else null), and notice_ids,
    the sorted identifiers of known one-line notices that are entire lines of the text (comma-joined, empty if none).

    A null or empty text, and a text of copyright lines only, has the digest of the empty string and no licence. Rows
    repeat as they come in; an empty table gives an empty result; other columns are ignored. One pass over the texts: digests
    of entire texts are joined to the licence table, which is broadcast if its counted rows are small, and lines are compared
    with the notices' digests; of more than most_notices these are joined too, by the distinct digests of each text's lines.
    """
    known = licenses.where("notice").select("license_digest", "license_id").limit(most_notices + 1).collect()
    few = len(known) <= most_notices
    # only short lines that name such a word after folding can be notices with one; any other notice set is compared with all lines
    hint = NOTICE_HINT if few and _hinted({r["license_digest"] for r in known}) else "^"
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(hint))
    digests = F.transform(lines, lambda x: F.sha2(canonical(x), 256))
    if not known:
        notice_ids = F.lit("")
    elif few:
        names = F.create_map(*[x for r in known for x in (F.lit(r["license_digest"]), F.lit(r["license_id"]))])
        found = F.array_intersect(F.array(*[F.lit(r["license_digest"]) for r in known]), digests)
        notice_ids = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: F.element_at(names, d)))), ",")
    else:
        docs, notice_ids = _with_notices(docs, licenses, digests)
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_digest"), notice_ids.alias("notice_ids"))
    ids = licenses.where(F.col("license_digest") != F.sha2(F.lit(""), 256)).select("license_digest", "license_id")
    return rows.join(small_side(ids, ids.count(), LICENSE_BYTES), F.col("canonical_digest") == F.col("license_digest"), "left").select(id_col, "canonical_digest", "license_id", "notice_ids")


def _with_notices(docs: DataFrame, licenses: DataFrame, digests: Column) -> tuple[DataFrame, Column]:
    """docs, written with a number for each row, and the column of its notices: lines are joined with the notices."""
    at, names = free_name("_at", docs.columns), free_name("_notices", docs.columns)
    rows = cut(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    notices = licenses.where("notice").select(F.col("license_digest").alias("_d"), "license_id")
    lines = rows.select(at, F.explode(F.array_distinct(digests)).alias("_d"))
    per = lines.join(small_side(notices, notices.count(), LICENSE_BYTES), "_d").groupBy(at).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias(names))
    return rows.join(per, at, "left"), F.coalesce(F.col(names), F.lit(""))


#: Bytes of a row of the licence table when broadcast.
LICENSE_BYTES = 256
NOTICE_HINT = "(?i)licen[sc]"


def _hinted(digests: set[str]) -> bool:
    """Whether all are built-in notices, each of which has the hint."""
    import hashlib

    fold = lambda t: re.sub(MARKS, " ", t.lower()).strip()
    mine = {hashlib.sha256(fold(t).encode()).hexdigest() for _, t in LICENSES if "\n" not in t and re.search(NOTICE_HINT, t) and not any(old in fold(t) for old, _ in SPELLINGS)}
    return digests <= mine


def oracle() -> str:
    """The same in DuckDB SQL over documents, for the built-in licences."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canon(column: str) -> str:
        out = f"regexp_replace(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quote(COPYRIGHT_LINE)}, '', 'g')"
        out = f"trim(regexp_replace({out}, {quote(MARKS)}, ' ', 'g'))"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return out

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    return f"""
WITH known_texts(license_id, body) AS (VALUES {values}),
known AS (SELECT sha256({canon("body")}) AS d, min(license_id) AS license_id, bool_or(NOT contains(trim(body), '\n')) AS notice FROM known_texts GROUP BY 1),
numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
line AS (SELECT r, unnest(string_split(text, '\n')) AS x FROM numbered),
notices AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM line JOIN known ON notice AND d = sha256({canon("x")}) GROUP BY r),
whole AS (SELECT r, doc_id, sha256({canon("text")}) AS c FROM numbered)
SELECT doc_id, c AS canonical_digest, known.license_id AS license_id, coalesce(ids, '') AS notice_ids
FROM whole LEFT JOIN notices USING (r) LEFT JOIN known ON d = c AND d <> sha256('')
"""
