"""Licence scan: canonical digests of entire texts, joined to known licence digests."""

from __future__ import annotations

import json
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pairs of spellings that count as equal (the second is kept), after lower-casing and within word ends.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("modernisation", "modernization"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("without limitation", "with out limitation"),
]
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Known entire texts: public licences and notices in their published wording.
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n\n" + _ISC + _ISC_END),
    ("ISC", _ISC + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAME = """{2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text): the entire licences of the folder licence_texts, named by their file, with and without what
    follows their terms; and the forms of the BSD licences with two and three clauses."""
    out = []
    for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        out.append((f.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(f.stem, terms), (f.stem, terms + end)]
    for (n, name), title, rights, mark, holder in product(((2, ""), (3, _BSD_NAME)), (True, False), ("All rights reserved.\n\n", ""), (("1.", "2.", "3."), ("*",) * 3), ("HOLDER", "OWNER")):
        head = f"BSD {n}-Clause License\n\n" if title else ""
        out.append((f"BSD-{n}-Clause", head + rights + (_BSD + name).format(*mark) + _BSD_END.format(holder=holder)))
    return out


#: What may stand before a line of a comment, and the forms of a line that states a copyright: with a sign, a year, a
#: placeholder or "by" after the word, or a sign before a year or the word; or at the start of a paragraph (of a text or
#: after an empty line, or after another such line), the word and a holder.
_COMMENT = r"[ \t*#/;-]*"
_SIGN = r"(?:\(c\)|©)"
_YEAR = r"[\[<{]?(?:[0-9]{4}|y{4}|year)"
_STATED = rf"(?m)^{_COMMENT}(?:copyright[ \t:]*(?:{_SIGN}|{_YEAR}|[\[<{{]|by\b)|{_SIGN}[ \t]*(?:{_YEAR}|copyright\b)|©)[^\r\n]*$"
_PROSE = r"notice|holder|owner|law|licen[cs]e|statement|and\b|or\b|in\b|is\b"
_HOLDER = rf"(?:\A|(?<=\A|\n){_COMMENT}\r?\n)(?:{_COMMENT}copyright[ \t]+(?!{_PROSE})[^\r\n]*(?:\r?\n|\z))+"


def canonical(text: Column) -> Column:
    """A-Z lower-cased; lines that state a copyright dropped, but not those where a line of prose begins so; everything but
    letters, digits and what lies beyond ASCII to single spaces; equivalent spellings unified, word by word."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(F.regexp_replace(out, _STATED, ""), _HOLDER, "\n\n")
    out = F.regexp_replace(out, r"https?://(www\.)?", " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’–—]+", " ")), F.lit(" "))
    # each word has blanks of its own, so that neighbours are both replaced
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for other, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} ".replace(" ", "  ")[1:-1]), F.lit(f" {kept} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licence) of known texts, each digest once (the smaller name where two share it). Empty texts are
    none."""
    rows = F.from_json(F.lit(json.dumps([{"licence": n, "text": t} for n, t in known])), "array<struct<licence: string, text: string>>")
    # a literal of the plan: no Python on the executors
    table = spark.range(1).select(F.inline(rows)).select(digest(F.col("text")).alias("digest"), "licence", canonical(F.col("text")).alias("c"))
    return table.where("c <> ''").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """docs with digest (of the canonical entire text), n_canonical (its length in characters) and licence (null where
    no known digest is equal).

    The known digests are broadcast where they are at most broadcast_rows, and else joined by a shuffle. Null and
    wordless texts have the digest of the empty text and no licence. Repeated rows match each. Very long texts are read
    whole. An empty table, of documents or of digests, gives no rows or no licences. Input columns with these names are
    replaced.
    """
    docs = docs.drop("digest", "n_canonical", "licence")
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    c = canonical(F.col(text))
    keyed = docs.withColumn("_c", c).withColumn("digest", F.sha2(F.col("_c").cast("binary"), 256)).withColumn("n_canonical", F.length("_c").cast("long")).drop("_c")
    return keyed.join(F.broadcast(known) if small else known, "digest", "left").select(*docs.columns, "digest", "n_canonical", "licence")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, known_digests(spark, KNOWN + whole_texts())).drop("text")


def _sql() -> str:
    """The same rows by another way: lines and words are tables, where a line or a word is kept or changed by itself."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    singles = {o: k for o, k in SPELLINGS if " " not in o and " " not in k}
    spelt = "MAP {" + ", ".join(f"{quote(o)}: {quote(k)}" for o, k in singles.items()) + "}"
    said = f"array_to_string(list_transform(w, lambda x: coalesce({spelt}[x], x)), ' ')"
    for other, kept in SPELLINGS:
        if other not in singles:
            said = f"regexp_replace({said}, '\\b{other}\\b', '{kept}', 'g')"
    stated = _STATED.removeprefix("(?m)")
    return rf"""
WITH t AS (SELECT 'd' AS side, doc_id AS k, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
  UNION ALL SELECT licence, row_number() OVER (), translate(text, '{_UPPER}', '{_LOWER}') FROM (VALUES {known}) AS v(licence, text)),
l AS (SELECT side, k, i, string_split(t, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM t)),
f AS (SELECT *, regexp_matches(line, '{stated}') OR regexp_matches(line, '^{_COMMENT}\r?$') AS bare,
  regexp_matches(line, '^{_COMMENT}copyright[ \t]+') AND NOT regexp_matches(line, '^{_COMMENT}copyright[ \t]+({_PROSE})') AS holds, regexp_matches(line, '{stated}') AS stated FROM l),
p AS (SELECT *, count(*) FILTER (bare) OVER (PARTITION BY side, k ORDER BY i) AS para FROM f),
r AS (SELECT *, count(*) FILTER (NOT holds AND NOT bare) OVER (PARTITION BY side, k, para ORDER BY i) AS prose FROM p),
j AS (SELECT side, k, string_agg(line, ' ' ORDER BY i) FILTER (NOT stated AND NOT (holds AND prose = 0)) AS t FROM r GROUP BY 1, 2),
w AS (SELECT side, k, regexp_extract_all(regexp_replace(coalesce(t, ''), 'https?://(www\.)?', ' ', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’–—]+') AS w FROM j),
c AS (SELECT side, k, {said} AS c FROM w),
known AS (SELECT c, min(side) AS licence FROM c WHERE side <> 'd' AND c <> '' GROUP BY 1)
SELECT k AS doc_id, sha256(c.c) AS digest, CAST(length(c.c) AS BIGINT) AS n_canonical, known.licence FROM c LEFT JOIN known USING (c) WHERE side = 'd'
"""


OP3_SQL = _sql()
