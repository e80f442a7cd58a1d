"""Licence scans by canonical digest, in DataFrame functions alone.

A text is normalised (case, copyright lines, punctuation, white space and line breaks, equivalent
spellings) and the SHA-256 of the whole is looked up among the digests of known licence texts by a
hash join. The same is done, as a second scope, for each of its lines and the digests of one-line
notices. Known digests are counted and broadcast if there are at most ``BROADCAST_ROWS``, as in the
catalogue; then documents are neither shuffled nor sorted. More of them meet the documents' digests in
a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that licence matching treats as equal, after punctuation is gone.
EQUIVALENT = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorise", "authorize"),
    ("favour", "favor"), ("per cent", "percent"), ("whilst", "while"), ("http ", "https "),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAME = "{0} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_2 = [_BSD.format("1.", "2.", ""), _BSD.format("*", "*", "")]
_BSD_3 = [_BSD.format("1.", "2.", _NAME.format("3.")), _BSD.format("*", "*", _NAME.format("*"))]
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
# Licence texts (kind "text"; titles are not part of every copy) and one-line notices (kind "notice").
CATALOGUE = [
    *[("MIT", "text", title + _MIT) for title in ("", "MIT License\n", "The MIT License\n", "The MIT License (MIT)\n")],
    *[("ISC", "text", title + _ISC) for title in ("", "ISC License\n", "The ISC License\n")],
    *[("0BSD", "text", title + _0BSD) for title in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")],
    *[("Zlib", "text", title + _ZLIB) for title in ("", "zlib License\n")],
    *[("BSD-2-Clause", "text", title + body) for title in ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n") for body in _BSD_2],
    *[("BSD-3-Clause", "text", title + body) for title in ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n") for body in _BSD_3],
    *[("Unlicense", "text", _UNLICENSE + tail) for tail in ("", "For more information, please refer to <https://unlicense.org/>", "For more information, please refer to <https://unlicense.org>")],
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."), ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "notice", "Released under CC0 1.0."),
    *[(x, "notice", f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-4.0", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")],
]
# Digests, by ``digest`` below, of licence texts as published.
DIGESTS = [
    # read in /usr/share/common-licenses of Debian
    ("Apache-2.0", "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
    # in the LICENSE files of the Python packages requests, packaging and hypothesis
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("MPL-2.0", "63d103028140311d6b6626068a7e68d3f9075ac3ac8affc96b02ccec0c64a7c6"),
    # in share/doc/rust/licenses of the Rust distribution
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("CC-BY-SA-4.0", "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d"),
    ("GPL-2.0", "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75"),
    ("ISC", "78d12b012407f04494ad9447817157c702f9bc389600604ae4e0d6a025f6d32f"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("NCSA", "bb6c44416437f5ab412ca9d762d4bdae1dc4e6a9c5afc9ac0965eb5e57b4e055"),
    ("OFL-1.1", "a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a"),
    ("Unicode-3.0", "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"),
    # other published copies of these versions, which were read before this list named its sources
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "b1c5aa1739d6987e6a07d17aec22866668fd58e96c5bf8b42f8885db04de1a31"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "01fb54bbeecb4129fbe6ad8f9e17f75e0e6746efafca1b4fc03d2a5b9d8059ae"),
    ("GPL-3.0", "45d55e6a1f1db973422ccbae8d15b1ad6389e7c384bfc422b46f5e230b86ecaf"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "45ab1a2a290e74e8c905ed1fbb6a81f1d48fe964330aa7855ba1aa1f88306f09"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "75fd50abdf9b6ede6e1241986dd3e5850aa7c83b83892f5bce9e206765724836"),
]

# The same patterns serve Spark and DuckDB. A copyright line has a sign, a year or "all rights reserved";
# a line of prose that begins with the word, or an item (c) of a list, is none.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;-]*("
    r"copyright[ \t:,]*(\(c\)|©|&copy;|[0-9]{4}|[<\[{])"
    r"|copyright[^\n]*([12][0-9]{3}|all rights reserved)"
    r"|\(c\)[ \t]*(copyright[ \t]*)?[12][0-9]{3}"
    r"|©|all rights reserved"
    r")[^\n]*"
)
BREAKS = "\r\x0b\x0c\x85\u2028\u2029"  # where regular expressions differ on what a line is
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t‘’“”–—"

#: Known digests, of some hundred bytes each, up to which they are broadcast.
BROADCAST_ROWS = 50_000


def _spelled(t: Column) -> Column:
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def canonical(text: Column) -> Column:
    """Normalised text that still has its line breaks."""
    t = F.regexp_replace(F.lower(F.translate(text, BREAKS, "\n" * len(BREAKS))), COPYRIGHT_LINE, "")
    t = F.translate(t, PUNCTUATION, " " * len(PUNCTUATION))
    return _spelled(F.regexp_replace(t, " {2,}", " "))


def whole(canonical_text: Column) -> Column:
    """Line breaks folded; spellings are looked at again, as one may have run over a line's end."""
    return F.trim(_spelled(F.regexp_replace(canonical_text, r"[ \n]+", " ")))


def digest(text: Column) -> Column:
    return F.sha2(whole(canonical(text)), 256)


def catalogue(spark: SparkSession, entries: list[tuple[str, str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id): one row for each distinct digest of the entries (id, kind, text) and digests (id, digest)."""
    rows = spark.createDataFrame(CATALOGUE if entries is None else entries, "license_id string, kind string, body string")
    known = rows.select(digest(F.col("body")).alias("digest"), "license_id")
    more = spark.createDataFrame(DIGESTS if digests is None else digests, "license_id string, digest string")
    return known.unionByName(more).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, license_id, scope, n): what each document of ``docs`` (doc_id, text) holds.

    scope "document": the entire text is that licence text or notice (n is 1); "line": n lines of it
    are that notice or one-line text. A document without a match, or with null, empty or blank text,
    has no row. Repeated rows of a document are scanned each and their counts added up; null ids are
    one document. Texts of any length are read whole, other columns are ignored, and an empty table
    gives an empty result. ``known`` (digest, license_id) is counted up to BROADCAST_ROWS to
    choose the join; of a digest that it repeats the least license_id is taken.
    """
    text = canonical(F.col("text").cast("string"))
    d = docs.where("text is not null").select(F.col("doc_id").cast("long"), text.alias("t"))
    unit = lambda scope, x: F.struct(F.lit(scope).alias("scope"), F.sha2(x, 256).alias("digest"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    units = F.array_append(F.transform(lines, lambda x: unit("line", F.trim(x))), unit("document", whole(F.col("t"))))
    each = d.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.scope", "u.digest")
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hits = each.join(known, "digest")
    return hits.groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), catalogue(spark))


def _sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_spelled(e: str) -> str:
    for old, new in EQUIVALENT:
        e = f"replace({e}, {_sql_string(old)}, {_sql_string(new)})"
    return e


def _sql_canonical(e: str) -> str:
    breaks = " || ".join(f"chr({ord(c)})" for c in BREAKS)
    e = f"translate({e}, {breaks}, repeat(chr(10), {len(BREAKS)}))"
    e = f"regexp_replace(lower({e}), {_sql_string(COPYRIGHT_LINE)}, '', 'g')"
    tab = _sql_string(PUNCTUATION).replace("\t", "' || chr(9) || '")
    e = f"translate({e}, {tab}, repeat(' ', {len(PUNCTUATION)}))"
    return _sql_spelled(f"regexp_replace({e}, ' {{2,}}', ' ', 'g')")


def _sql_whole(e: str) -> str:
    folded = f"regexp_replace({e}, '[ \\n]+', ' ', 'g')"
    return f"trim({_sql_spelled(folded)})"


def _oracle() -> str:
    values = ", ".join(f"({_sql_string(i)}, {_sql_string(b)})" for i, _, b in CATALOGUE)
    digests = " ".join(f"UNION ALL SELECT {_sql_string(i)}, {_sql_string(d)}" for i, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(id) AS license_id FROM (
    SELECT id, sha256({_sql_whole(_sql_canonical('body'))}) AS digest
    FROM (VALUES {values}) v(id, body) {digests}) GROUP BY 1),
d AS (SELECT doc_id, {_sql_canonical('text')} AS t FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'line' AS scope, sha256(trim(x)) AS digest
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE trim(x) <> ''
  UNION ALL SELECT doc_id, 'document', sha256({_sql_whole('t')}) FROM d)
SELECT doc_id, license_id, scope, count(*) AS n FROM units JOIN known USING (digest) GROUP BY ALL"""


ORACLE_SQL = _oracle()
