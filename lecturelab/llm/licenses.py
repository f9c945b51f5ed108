"""Licence scans by canonical digest: a text is a known licence if it equals one once both are normalised.

Normalising lowers case, drops copyright and rights-reserved lines, settles equivalent spellings, and turns
everything but letters and digits into single spaces; the digest is SHA-256. Whole texts are joined to the known
digests, and so is every line of a text as a text of its own, which finds short notices inside longer documents.

Known are whole licences with and without their headings, short notices, and digests of licences too long to be kept
here; both lists are parameters. Copyright lines go with their comment signs, whoever the holder; other comment signs go with
the punctuation. The known texts are a short table; Spark sees their size and broadcasts them itself. Hits inside one document are
merged by a partial aggregate, so equal texts, however many, need no gathering.

Edge cases: a null text has a null digest and no licence; a text that is empty once normalised has the digest of the
empty text and no licence; very long texts are digested whole; repeated rows are scanned alike, each for itself; an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import materialise

#: (spelling, settled spelling), applied in order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("whomsoever", "whomever"),
    ("https:", "http:"), ("&", " and "), ("version ", "v "),
)
#: A line that names a holder, after any comment signs; a holder without sign or year is a name with a capital.
COPYRIGHT = (
    r"(^|\n)[ \t#/*;>%<!-]*(?:(?i:copyright)[ \t]*(?:(?i:\(c\))|©|[0-9]{4}|<|\[|(?:by[ \t]+)?\p{Lu}\p{Ll})"
    r"|©|(?i:\(c\))[ \t]*[0-9]{4}|(?i:all rights reserved))[^\n]*")
NOT_WORD = r"[^\p{L}\p{N}\n]+"

# fixed values: public licence texts, notices, headings, and digests of long licences
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
"""
BSD_CONDITIONS = ("""Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
""", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
""")
BSD_NAME = ("""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
""",)
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def numbered(conditions: Sequence[str]) -> str:
    return "".join(f"{n}. {text}" for n, text in enumerate(conditions, 1))


KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", BSD_START + "".join(BSD_CONDITIONS) + BSD_END),
    ("BSD-2-Clause", BSD_START + numbered(BSD_CONDITIONS) + BSD_END),
    ("BSD-3-Clause", BSD_START + "".join(BSD_CONDITIONS + BSD_NAME) + BSD_END),
    ("BSD-3-Clause", BSD_START + numbered(BSD_CONDITIONS + BSD_NAME) + BSD_END),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES
OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Lines that may stand above the text of a licence.
HEADINGS: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("ISC", "The ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "The 2-Clause BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "The 3-Clause BSD License"), ("0BSD", "BSD Zero Clause License"), ("Unlicense", "The Unlicense"), ("Zlib", "zlib License"),
    ("Zlib", "The zlib/libpng License"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
)
#: (licence, digest) of published texts too long to be kept here, by `digest`.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "bf9e53461f8a8ae03f6f88fc86d772374b742a084afa5654d3e334c7591208d5"),
    ("CC0-1.0", "92f195ae84ff559b03177551e6c1166f57d3cc30f5a7d806b4039e24906bd8de"),
    ("GPL-1.0", "8f04eb9fe7e837ec7b0c826163174a5f7b84d0e6b8d636c4bfd58608fb90422f"),
    ("GPL-2.0", "101f16f33272ca6fb4c824d1b814899be94adb06591b4ee10f56c86075bf85fc"),
    ("GPL-3.0", "f2a1e3f7c77c3911a1b022b17799bc83efb3a6f513f2a906fa38c0e0a569f4c8"),
    ("LGPL-2.0", "dcd932df4392e212883e39575f26a40f0a9de2de904f9dd74e62f4319598ae6d"),
    ("LGPL-2.1", "0e0339042f8bd20f6bf60072f1d89de5ea0503e6873dbe8f85977cb53e4bf489"),
    ("LGPL-3.0", "5981bda2f9b9883bbef4937805e82fb10540c2a8c1ddca42628965a84b205bd5"),
    ("MPL-1.1", "1409bb680201c1eb3b295df15707ad844f02cd6cfe40476b8519119144190841"),
    ("MPL-2.0", "2dbafd292de62078973e9ecc5bbb1b360e011f48e4ff5274d204ddec3fbe65e4"),
)


def known_texts(known: Sequence[tuple[str, str]] = KNOWN, headings: Sequence[tuple[str, str]] = HEADINGS) -> list[tuple[str, str]]:
    """The known texts, and those of more than one sentence also under each heading of their licence."""
    whole = [(name, text) for name, text in known if len(text) > 200]
    return [*known, *((name, f"{heading}\n{text}") for name, text in whole for licence, heading in headings if licence == name)]


def canonical_lines(text: Column) -> Column:
    """The text as digests see it, its lines still apart."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT, "$1"))
    for spelling, settled in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(settled))
    return F.regexp_replace(out, NOT_WORD, " ")


def canonical(lines: Column) -> Column:
    return F.btrim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(canonical_lines(text)), 256)


def known_digests(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """Stored, so that Spark knows how small it is and moves neither texts nor digests to meet it."""
    texts = docs.sparkSession.createDataFrame(known_texts(known), "licence string, text string").select("licence", digest(F.col("text")).alias("_known"))
    rows = texts.unionByName(docs.sparkSession.createDataFrame([*digests], "licence string, _known string"))
    return materialise(rows.groupBy("_known").agg(F.min("licence").alias("_licence")), "licences")


def notices(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `notice` (the first by name), `n_notices`: documents with lines that are known texts by themselves."""
    lines = F.split(canonical_lines(F.col(text)), "\n")
    spoken = F.filter(F.transform(lines, lambda x: F.btrim(x)), lambda x: x != "")
    each = docs.select(F.col(key).alias("_key"), F.explode(spoken).alias("_line")).select("_key", F.sha2("_line", 256).alias("_digest"))
    hits = each.join(known, F.col("_digest") == F.col("_known"))
    return hits.groupBy(F.col("_key").alias(key)).agg(F.min("_licence").alias("notice"), F.count("*").alias("n_notices"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """key, `digest`, `licence` (the whole text is this licence), `notice` (a line is), `n_notices` (such lines).

    Rows that repeat an id share its notices.
    """
    table = known_digests(docs, known, digests)
    whole = docs.select(F.col(key).alias("_key"), digest(F.col(text)).alias("digest"))
    named = whole.join(table, F.col("digest") == F.col("_known"), "left")
    found = notices(docs, table, key, text).withColumnRenamed(key, "_id")
    return named.join(found, F.col("_key").eqNullSafe(F.col("_id")), "left").select(
        F.col("_key").alias(key), "digest", F.col("_licence").alias("licence"), "notice", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"))


def oracle(known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> str:
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def lines(text: str) -> str:
        out = f"lower(regexp_replace({text}, {quoted(COPYRIGHT)}, '\\1', 'g'))"
        for spelling, settled in SPELLINGS:
            out = f"replace({out}, {quoted(spelling)}, {quoted(settled)})"
        return f"regexp_replace({out}, {quoted(NOT_WORD)}, ' ', 'g')"

    def whole(text: str) -> str:
        return f"sha256(trim(regexp_replace({text}, '[ \\n]+', ' ', 'g')))"

    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known_texts(known))
    listed = ", ".join(f"({quoted(name)}, {quoted(value)})" for name, value in digests)
    return f"""
with known as (select known, min(licence) as licence from (select {whole(lines('text'))} as known, licence from (values {rows}) t(licence, text)
    union all select known, licence from (values {listed}) d(licence, known)) group by 1),
docs as (select doc_id, {lines('text')} as ls from documents),
each as (select doc_id, trim(line) as line from (select doc_id, unnest(string_split(ls, chr(10))) as line from docs) where trim(line) <> ''),
found as (select doc_id as id, min(licence) as notice, count(*) as n from each join known on sha256(line) = known group by 1)
select doc_id, {whole('ls')} as digest, licence, notice, coalesce(n, 0)::bigint as n_notices
from docs left join known on {whole('ls')} = known left join found on doc_id is not distinct from id"""
