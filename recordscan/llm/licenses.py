"""License scans by canonical digest lookup.

Texts and known license texts are brought to one canonical form (case,
punctuation, copyright lines and equivalent spellings do not count); entire
texts are joined to the known ones by the digest of that form. Only texts that
hold a word which some known text holds in any case are brought to it.
"""

from __future__ import annotations

import os
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spellings that mean the same, the first form standing for both.
SPELLINGS = [
    ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"), ("sublicense", "sublicence"), ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"),
    ("artifact", "artefact"), ("authorization", "authorisation"), ("authorized", "authorised"), ("center", "centre"), ("color", "colour"), ("copyright holder", "copyright owner"), ("customization", "customisation"),
    ("defense", "defence"), ("favor", "favour"), ("fulfill", "fulfil"), ("initialize", "initialise"), ("judgment", "judgement"), ("labor", "labour"), ("merchantability", "merchantibility"), ("noncommercial", "non commercial"),
    ("organization", "organisation"), ("per cent", "percent"), ("program", "programme"), ("recognize", "recognise"), ("utilization", "utilisation"), ("while", "whilst"), ("website", "web site"),
]

# Texts of licenses and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
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
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: (name, scope, text). Scope text: a license or notice as a whole; line: one sentence that grants or names a license.
KNOWN = [
    ("MIT", "text", "MIT License\n\n" + _MIT), ("MIT", "text", "The MIT License\n\n" + _MIT), ("MIT", "text", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "text", _MIT),
    ("ISC", "text", "ISC License\n\n" + _ISC), ("ISC", "text", _ISC),
    ("0BSD", "text", "BSD Zero Clause License\n\n" + _ZERO_BSD), ("0BSD", "text", _ZERO_BSD),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END), ("BSD-2-Clause", "text", _BSD_START + _BSD_END),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_NAMES + _BSD_END), ("BSD-3-Clause", "text", _BSD_START + _BSD_NAMES + _BSD_END),
    ("Zlib", "text", "zlib License\n\n" + _ZLIB), ("Zlib", "text", _ZLIB), ("Unlicense", "text", _UNLICENSE),
    ("Apache-2.0", "text", _APACHE_NOTICE), ("GPL-3.0-or-later", "text", _GPL3_NOTICE),
    ("MIT", "line", "Released under the MIT License."), ("MIT", "line", "Licensed under the MIT License."), ("MIT", "line", "This work is licensed under the MIT License."),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "line", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "line", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "line", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "line", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "line", "Licensed under CC0 1.0."),
]

TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


@cache
def known_texts() -> tuple[tuple[str, str, str], ...]:
    """(name, scope, text) of all known texts: KNOWN and the whole licenses in the folder TEXTS."""
    whole = []
    for f in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, f), encoding="utf-8") as t:
            text = t.read()
        whole.append((f.removesuffix(".txt"), "text", text))
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        if rest:  # without what says how to apply it
            whole += [(f.removesuffix(".txt"), "text", terms), (f.removesuffix(".txt"), "text", terms + end)]
    return (*KNOWN, *whole)


#: A line that states a copyright: with a year, a sign or a place for them, or nothing but the reservation of rights.
_COPYRIGHT = r"(?m)^[\s#*/;-]*(?:copyright\s*(?:\(c\)|©|[0-9]{4}|[<\[{]|by\b)|\(c\)\s*(?:copyright|[0-9]{4})|©)[^\n]*$|^[\s#*/;-]*all rights reserved[^\w\n]*$"


def anchors(known, scope: str) -> str:
    """A regular expression that every text holds, lower-cased, whose canonical form is that of a known one: its longest word, in any spelling."""
    spellings: dict[str, set[str]] = {}
    torn = set()
    for forms in SPELLINGS:
        if all(" " not in f for f in forms):
            for f in forms:
                spellings.setdefault(f, set(forms)).update(forms)
        else:
            torn.update(w for f in forms for w in f.split())
    found = set()
    for _, s, text in known:
        if s == scope:
            kept = re.sub(_COPYRIGHT, " ", text.lower())
            words = [w for w in re.findall(r"[^\W_]+", kept) if w not in torn]
            best = max(words, key=lambda w: (len(w), w), default="")
            found |= {re.escape(f) for f in spellings.get(best, {best})}
    return "|".join(sorted(found, key=lambda w: (-len(w), w)))


def canonical(text: Column) -> Column:
    """Canonical form of a text: lower case, no copyright lines, one spelling, words of letters and digits with one space between."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, " ")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    # an alternative spelling starts and ends at a space; spaces are doubled so that neighbours do not share one
    plain = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for one, other in SPELLINGS:
        a, b = (f" {x.replace(' ', '  ')} " for x in (one, other))
        plain = F.replace(plain, F.lit(b), F.lit(a))
    return F.trim(F.regexp_replace(plain, " +", " "))


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """license, scope, digest of every known text."""
    rows = spark.createDataFrame(list(known_texts() if known is None else known), "license string, scope string, text string")
    return rows.select("license", "scope", digest(canonical(F.col("text"))).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, known=None) -> DataFrame:
    """What licenses the texts of docs (doc_id, text; other columns are ignored) are or name.

    known: (name, scope, text) of each known text, those of known_texts()
    where none are given. A row for each doc_id row whose entire text (scope
    text) or one or more of whose lines (scope line) have the digest of a known
    license: doc_id, scope, license, n (1, or the lines). Null and empty texts
    match nothing; repeated rows count each; an empty table gives no rows; no
    known texts match nothing. Every text and every line is looked at.
    """
    known = list(known_texts() if known is None else known)
    digests = known_digests(docs.sparkSession, known)
    candidates = []
    for scope in ("text", "line"):
        if not (words := anchors(known, scope)):
            continue
        rows = docs.select("doc_id", F.col("text").alias("said")) if scope == "text" else docs.filter(F.lower("text").rlike(words)).select("doc_id", F.explode(F.split("text", "\n")).alias("said"))
        candidates.append(rows.filter(F.lower("said").rlike(words)).select("doc_id", F.lit(scope).alias("scope"), canonical(F.col("said")).alias("form")))
    if not candidates:
        return docs.limit(0).select("doc_id", F.lit("text").alias("scope"), F.lit("").alias("license"), F.lit(0).cast("long").alias("n"))
    found = candidates[0] if len(candidates) == 1 else candidates[0].unionByName(candidates[1])
    found = found.filter("form <> ''").withColumn("digest", digest(F.col("form")))
    # one row for each known text; whether it is broadcast is left to its size
    return found.join(digests, ["scope", "digest"]).groupBy("doc_id", "scope", "license").agg(F.count(F.lit(1)).alias("n"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents and of their lines."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in DuckDB's SQL, over the same known texts."""

    def form(x: str) -> str:
        y = rf"trim(regexp_replace(regexp_replace(lower({x}), '{_COPYRIGHT}', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        y = f"' ' || replace({y}, ' ', '  ') || ' '"
        for one, other in SPELLINGS:
            a, b = (f" {s.replace(' ', '  ')} " for s in (one, other))
            y = f"replace({y}, '{b}', '{a}')"
        return f"trim(regexp_replace({y}, ' +', ' ', 'g'))"

    quoted = ", ".join(f"('{n}', '{s}', '" + t.replace("'", "''") + "')" for n, s, t in known_texts())
    return f"""
WITH known AS (SELECT DISTINCT license, scope, {form("text")} AS form FROM (VALUES {quoted}) AS t(license, scope, text)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (
    SELECT doc_id, 'text' AS scope, {form("text")} AS form FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?i)licen[sc]|permission|redistribution|provided|free')
    UNION ALL
    SELECT doc_id, 'line', {form("line")} FROM lines WHERE regexp_matches(lower(line), 'licen[sc]|\\bcc')
)
SELECT doc_id, f.scope, license, count(*) AS n FROM found f JOIN known k ON f.scope = k.scope AND f.form = k.form
GROUP BY doc_id, f.scope, license
"""


ORACLE = _oracle()
