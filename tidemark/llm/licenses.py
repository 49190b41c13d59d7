"""License scans by canonical digest lookup, with DataFrame functions only.

Texts are brought to a canonical form (case, copyright lines, equivalent spellings, punctuation, white space) and their digests are
joined to the digests of known licence texts, treated in the same way. Whole documents are looked up, and where a document names a
licence at all, each of its paragraphs and lines as a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices in common use.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD.replace("THIS SOFTWARE IS PROVIDED BY", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
# Identifiers of the SPDX list whose one-line tags are known.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 NCSA OFL-1.1 "
    "OpenSSL PostgreSQL PSF-2.0 Ruby Unlicense UPL-1.0 WTFPL X11 Zlib ZPL-2.1"
).split()
LICENSES = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0", _GPL_NOTICE),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
]
# Digests of the canonical forms of longer licence texts, as their stewards publish them.
DIGESTS = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "bcf1ca6bfc638eb154167518097e0e35e99b24f6b9bb4b2a6cb9b919bfda843a"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "00e1d0edf2cfd4be6c57c4bb956c71685a048817583a60ec79be9d1750aeb66f"),
    ("GPL-1.0", "8a4692e318e41e8d96d4610f021d16f03ff4485322f3d81c00d2621fdda7b2b1"),
    ("GPL-2.0", "0248b317bc123a7424b6ff9799b9786ffde75241881994270612a604d03836cc"),
    ("GPL-3.0", "335e2e9a39badb7f3faa5b6e393ff8b393f868383be9ddbf866c5821b34f4810"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "010ef3e2d3efceb19d44336a9aba2f54fa650cd537869380f53f4d6acad82b50"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
# Spellings that mean the same.
SPELLINGS = [("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("noninfringement", "non infringement"), ("per cent", "percent"), ("https", "http"), ("creative commons", "cc")]
COPYRIGHT_LINE = r"(^|\n)[^\n]*(copyright [0-9(©<\[]|copyright:|\(c\) [0-9]|© ?[0-9]|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text without any of these can't be a known text; `known` checks that the known texts have one.
TRIGGERS = "licen|permi"
#: Known digests are broadcast up to so many rows of about 100 bytes; beyond, they are joined by shuffle.
BROADCAST_ROWS = 50_000


def canonical(text: Column) -> Column:
    out = F.lower(text)
    out = F.when(out.rlike("copyright|\\(c\\)|©|all rights"), F.regexp_replace(out, COPYRIGHT_LINE, "\n")).otherwise(out)
    for word, same in SPELLINGS:
        out = F.replace(out, F.lit(word), F.lit(same))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def known(spark: SparkSession, licenses: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest) of known texts and digests, one row a digest; LICENSES and DIGESTS unless others are given."""
    rows = spark.createDataFrame(licenses or LICENSES, "license string, text string").withColumn("c", canonical(F.col("text")))
    bad = rows.where(~F.col("c").rlike(TRIGGERS)).count()
    if bad:
        raise ValueError(f"{bad} known texts have no word of TRIGGERS, by which documents are looked through")
    more = spark.createDataFrame(DIGESTS if digests is None else digests, "license string, digest string")
    rows = rows.select("license", F.sha2(F.col("c").cast("binary"), 256).alias("digest")).unionByName(more)
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_digest, whole_license, n_matches, licenses.

    text_digest is that of the whole canonical text; whole_license the licence whose text it is, or null; n_matches counts the
    document, its paragraphs and lines that are known texts, and licenses names them, sorted. Null is the empty text. Repeated rows
    come back as often as they were given. Licences with many matching lines cost a row for each; nothing is collected but names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.xxhash64(text_col).alias("h"))
    digest = lambda t: F.sha2(canonical(t).cast("binary"), 256)
    unit = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), digest(t).alias("digest"))
    named = lambda t: F.lower(t).rlike(TRIGGERS)
    lines = F.transform(F.filter(F.split("t", "\n"), named), unit("line"))
    parts = F.filter(F.split("t", "\n[ \t\r]*\n"), named)
    parts = F.when(F.col("t").rlike("\n[ \t\r]*\n"), F.transform(parts, unit("paragraph"))).otherwise(F.array().cast("array<struct<kind:string,digest:string>>"))
    own = F.array(unit("document")(F.col("t")))
    units = F.when(named(F.col("t")), F.concat(own, parts, F.when(F.col("t").contains("\n"), lines).otherwise(F.array().cast("array<struct<kind:string,digest:string>>")))).otherwise(own)
    rows = rows.select("doc_id", "h", F.explode(units).alias("u")).select("doc_id", "h", "u.kind", "u.digest")
    small = licenses.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(licenses) if small else licenses, "digest", "left").where("license is not null or kind = 'document'")
    whole = F.col("kind") == "document"
    found = met.groupBy("doc_id", "h").agg(
        F.sum(whole.cast("int")).alias("copies"), F.max(F.when(whole, F.col("digest"))).alias("text_digest"), F.max(F.when(whole, F.col("license"))).alias("whole_license"),
        F.count("license").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    found = found.withColumn("n_matches", F.expr("n div copies")).withColumn("each", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", "text_digest", "whole_license", "n_matches", "licenses")


def sql() -> str:
    """The same rows as `scan` over `documents`, in DuckDB."""
    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', chr(10), 'g')"
        for word, same in SPELLINGS:
            out = f"replace({out}, '{word}', '{same}')"
        return f"sha256(trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')))"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in LICENSES)
    more = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(l) AS license FROM (SELECT l, {form('t')} AS digest FROM (VALUES {values}) v(l, t) UNION ALL SELECT * FROM (VALUES {more}) w(l, digest)) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT doc_id, 'document' AS kind, t FROM d
  UNION ALL SELECT doc_id, 'line', unnest(string_split(t, chr(10))) FROM d WHERE contains(t, chr(10))
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) FROM d WHERE regexp_matches(t, '\n[ \t\r]*\n')
), hit AS (
  SELECT doc_id, kind, license FROM (SELECT doc_id, kind, {form('t')} AS digest FROM units WHERE regexp_matches(lower(t), '{TRIGGERS}')) JOIN known USING (digest)
)
SELECT d.doc_id, {form('d.t')} AS text_digest, max(CASE WHEN kind = 'document' THEN license END) AS whole_license, count(license) AS n_matches,
       coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id, d.t
"""
