"""License scans: canonical digests of whole texts, looked up by a hash join, in built-in functions only.

A text is made canonical: lower case, copyright lines dropped, equivalent spellings mapped to one, everything
but letters and digits to single spaces, so that comment signs and the wrapping of lines play no part. The SHA-256 of the
result is joined with the digests of known texts, which come from the same function. Whole documents are looked up, and
so is every known text inside a document: wherever the first two words of known texts stand at the beginning of a line, as
many words as each of these has are taken from there on and looked up by their digest, if they end where a line ends.

Known are the notices and short licences of KNOWN, with their titles and without, and the long licences whose digests
DIGESTS holds; known_licenses() makes a table of a caller's own. It is broadcast while it numbers at most BROADCAST_KNOWN
texts, otherwise joined by a shuffle. Null and empty texts match nothing. Several known texts with one digest: the smallest id
is reported. Repeated rows get equal results. Only doc_id and text are read; other columns, whatever their names, do not
matter. Empty tables: no documents, no rows; nothing known, no matches. Very long texts: patterns are matched without
backtracking, a place where a known text may begin costs a pass over the document's lines and the words taken from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import staged

BROADCAST_KNOWN = 100_000
#: Up to so many beginnings are looked for in a document before its lines are kept for the join; beyond it all are kept.
FEW_HEADS = 2000

_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Known notices and short licences, fixed values: (identifier, text). Copyright lines play no part.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("proprietary", "All rights reserved."),
)

#: Titles that may stand above a text of KNOWN of more than 60 words.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense",),
}

#: Long licences: identifier, first two words, number of words and SHA-256 of the canonical text, as the texts that Debian's
#: base-files puts under /usr/share/common-licenses give them (published there word for word; holders' lines are dropped).
DIGESTS = (
    ("Apache-2.0", "apache license", 1594, "8ef46259cbb1cc814f97024f75e027f30ae5a905592c0d9785545b2af450b389"),
    ("Artistic-1.0-Perl", "the artistic", 982, "698ed693149f86edbe1d0e774a55f8f4e126b3ad65eef3ce26cf88e86d7f7970"),
    ("CC0-1.0", "creative commons", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free", 3312, "d95c234ae5fd79052b0f2c46e7fb020aab58f0dd82ea811a4fb2f28cc467edcc"),
    ("GFDL-1.3", "gnu free", 3729, "3209be47de58b93782688c7d9082457fdd9dc9f2787c41054ba60a3f37bbb667"),
    ("GPL-1.0", "gnu general", 2064, "c99c820668a8e870b9ab2d3fde5095f0fc8d8fce7728a0dac7c485018d22649e"),
    ("GPL-2.0", "gnu general", 2972, "d1fa61212ae86f10c1b0ea5c8db2b3512d73899ca35873143cc967722492e2b6"),
    ("GPL-3.0", "gnu general", 5679, "b07aae232fe7102b06aac1554c541500375161e2927ea3c491131d1d067a8bac"),
    ("LGPL-2.0", "gnu library", 4195, "a888d77e6cc8e53e11ee3ed23bccf3baaabdb48b46cd0cd50afaae864da4e6b3"),
    ("LGPL-2.1", "gnu lesser", 4396, "f8b1d38ac8ea665fe831af3585b7a2308e9b913f9b67be6f8b9716d7bb485690"),
    ("LGPL-3.0", "gnu lesser", 1227, "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6"),
    ("MPL-1.1", "mozilla public", 3756, "ceb02c1864721d37df8fa7de1ecb6a217cb5ea5704b7d9452bc4fcec7f5b8e11"),
    ("MPL-2.0", "mozilla public", 2405, "78f5f43323f3d13d0d8ac32186b0cbe0d70d3940566843a857277793dec17669"),
)


#: Spellings that licence matching treats as equal, in canonical words: (literal, replacement).
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("https ", "http "),
)
#: A version's number is one word with what announces it, on whichever line it stands.
VERSION, VERSION_NUMBER = r"\b(?:version|v)[ \n]+([0-9])", "v"
#: A holder's line, not a wrapped sentence that happens to start with the word.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n]*(?:copyright[ \t]*(?:\(c\)|[0-9]{4}|by\b|:)|\(c\)).*$"


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical words, without empty ones."""
    out = F.replace(F.lower(text), F.lit("\u00a9"), F.lit("(c)"))
    out = F.when(F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")), F.regexp_replace(out, COPYRIGHT_LINE, " ")).otherwise(out)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for literal, replacement in SPELLINGS:
        out = F.replace(out, F.lit(literal), F.lit(replacement))
    out = F.regexp_replace(out, VERSION, f"{VERSION_NUMBER}$1")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _head(line: Column) -> Column:
    return F.substring_index(line, " ", 2)


def _heads(lines: Column) -> Column:
    """Where a known text may begin, as struct<line, head>: each line's first two words, the next line's among them, or its only one."""
    two = F.transform(lines, lambda x, i: F.struct(i.alias("line"), _head(F.concat_ws(" ", x, F.get(lines, i + 1))).alias("head")))
    one = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("head"))), lambda x: ~F.contains(x["head"], F.lit(" ")))
    return F.concat(two, one)


def _words(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def variants(known=KNOWN) -> list[tuple[str, str]]:
    """The texts, and the longer ones below each of their titles."""
    return [*known, *((i, f"{title}\n{text}") for i, text in known if len(text.split()) > 60 for title in TITLES.get(i, ()))]


def known_licenses(spark: SparkSession, known=None, digests=None) -> DataFrame:
    """digest, license, head, n: the lookup table of texts (identifier, text) and of digests; by default of all that is known here."""
    known, digests = (variants() if known is None else known), (DIGESTS if known is None and digests is None else digests or ())
    lines = spark.createDataFrame(list(known), "license string, body string").select("license", canonical_lines(F.col("body")).alias("lines")).filter(F.size("lines") > 0)
    text = F.array_join("lines", " ")
    rows = lines.select(F.sha2(text, 256).alias("digest"), "license", _head(text).alias("head"), _words(text).alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(d, i, h, n) for i, h, n, d in digests], "digest string, license string, head string, n int"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.first("head").alias("head"), F.first("n").alias("n"))


def licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_sha256, license_id (of the whole text, or null), n_notices (lines at which known texts begin), notices (their distinct ids, sorted, comma-joined)."""
    spark = docs.sparkSession
    table = staged(known_licenses(spark) if known is None else known, "license-known")
    small = table.count() <= BROADCAST_KNOWN
    cast = F.broadcast if small else (lambda df: df.hint("merge"))
    heads = table.select("head", "n").distinct()
    some = [r["head"] for r in table.select("head").distinct().limit(FEW_HEADS + 1).collect()]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = texts.select("doc_id", F.xxhash64("t").alias("h"), canonical_lines(F.col("t")).alias("lines"))
    own = F.transform(_heads(F.col("lines")), lambda x: x["head"])
    met = F.lit(True) if len(some) > FEW_HEADS else F.arrays_overlap(own, F.array(*map(F.lit, some))) if some else F.lit(False)
    # one pass over the texts: every digest, and the lines where a known text may begin
    whole = F.when(F.size("lines") > 0, F.sha2(F.array_join("lines", " "), 256))
    rows = staged(rows.select("doc_id", "h", whole.alias("digest"), F.when(met, F.col("lines")).alias("lines")), "license-lines")
    held = rows.filter(F.size("lines") > 0)
    begin = held.select("doc_id", "h", F.explode(_heads(F.col("lines"))).alias("x")).select("doc_id", "h", "x.line", "x.head")
    begin = begin.join(cast(heads), "head").groupBy(F.col("doc_id").alias("doc_id2"), F.col("h").alias("h2")).agg(F.collect_set(F.struct("line", "n")).alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("h") == F.col("h2"))
    both = held.dropDuplicates(["doc_id", "h"]).join(begin, same)

    def taken(lines: Column, x: Column) -> Column:
        """The digest of n words from a line on, or null if these do not end with a line."""
        part = F.slice(lines, x["line"] + 1, x["n"])
        zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("met"))
        ends = F.aggregate(part, zero, lambda a, line: F.struct((a["n"] + _words(line)).alias("n"), (a["met"] | (a["n"] + _words(line) == x["n"])).alias("met")), lambda a: a["met"])
        return F.struct(x["line"].alias("line"), F.when(ends, F.sha2(F.call_function("substring_index", F.array_join(part, " "), F.lit(" "), x["n"]), 256)).alias("digest"))

    hits = both.select("doc_id", "h", F.explode(F.transform("places", lambda x: taken(F.col("lines"), x))).alias("x"))
    hits = hits.select("doc_id", "h", F.col("x.line").alias("line"), F.col("x.digest").alias("digest")).filter("digest is not null")
    hits = hits.join(cast(table.select("digest", "license")), "digest")
    hits = hits.groupBy(F.col("doc_id").alias("doc_id2"), F.col("h").alias("h2")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.countDistinct("line").alias("n_notices"))
    named = rows.select("doc_id", "h", "digest").join(cast(table.select("digest", F.col("license").alias("license_id"))), "digest", "left")
    out = named.join(hits, same, "left")
    return out.select("doc_id", F.col("digest").alias("text_sha256"), "license_id", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
