"""Operator 8: documents that are a known licence, by the digest of their canonical text.

Canonical text: ASCII letters in lower case; lines that state a copyright and
"all rights reserved" dropped; everything but letters, digits and spaces turned
into spaces; equivalent spellings made one at the beginnings of words; spaces
collapsed.  A line is dropped only if it states a copyright (a sign, a year, a
placeholder or a holder follows): a line of a licence's body may begin with the
word by the way it is wrapped.  Whole texts are compared, by the SHA-256 of
their canonical form, with a table of known digests.  That table is one row for
each published form, so it is broadcast below ``BROADCAST_ROWS`` and joined by
shuffle beyond.

Titles, list numbers and appendices are told apart in the table of known
licences (``published``), not in the documents.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests below this are sent to every executor (under 100 bytes each).
BROADCAST_ROWS = 100_000

#: Equivalent spellings, as the guidelines for matching licence texts list them.  Each is
#: replaced where a word begins with it, so that inflected forms follow; of two spellings of which one begins
#: the other, the longer becomes the shorter.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfill", "fulfil"),
    ("fulfillment", "fulfilment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilfull", "wilful"), ("willful", "wilful"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"), ("http ", "https "),
)

#: Texts of short licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace("\n\nTHIS SOFTWARE", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE""", 1)
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
NOTICES = {
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}
KNOWN = {"MIT": MIT, "ISC": ISC, "0BSD": ZERO_BSD, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "Zlib": ZLIB, **NOTICES}

#: Full texts, one file each.
FULL = Path(__file__).parent / "licences"
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
#: Where the terms of a full text end and its appendix begins.
APPENDIX = re.compile(r"\n[ \t]*(END OF TERMS AND CONDITIONS|Exhibit A - )")
_LEAD = r"[ \t*#/;>-]*"
_PLAIN = (
    "notices?|holders?|holder's|owners?|ownership|owned|laws?|licen[sc]es?|licensors?|statements?|interests?|permissions?|disclaimers?"
    "|doctrines?|treaty|treaties|act|rights?|claims?|messages?|information|protection|infringement|term|status|and|or|to|in|on|of|for|is|are|as|over|under|with|from"
    r"|if|that|this|these|those|which|resulting|can|may|will|must|shall|applicable|the[ \t]+(software|program|library|work|code)"
)
#: A line that states a copyright (a sign, a year, a placeholder or a holder follows), in lower case.
STATEMENT = (
    rf"(^|\n){_LEAD}("
    r"copyright[ \t]*[:,]?[ \t]*([(]c[)]|©|&copy;|[12][0-9]{3}|[<\[{]|by[ \t]|yyyy)"
    r"|[(]c[)][ \t]*(copyright|©|[12][0-9]{3}|[<\[{])"
    r"|©"
    rf"|copyright[ \t]+(?!({_PLAIN})([^a-z0-9_]|\z)|the[ \t]*([\r\n]|\z))[a-z]"
    r")[^\n]*"
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical(column: str = "text") -> Column:
    """The canonical text; a null text counts as empty."""
    x = F.translate(F.coalesce(column, F.lit("")), _UPPER, _UPPER.lower())
    x = F.regexp_replace(x, STATEMENT, "\n")
    x = F.regexp_replace(x, "all rights reserved", " ")
    # two spaces between words and one at the ends: a replaced word shares none with its neighbours
    x = F.concat(F.lit(" "), F.regexp_replace(x, "[^a-z0-9]+", "  "), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a}" if a.endswith(" ") else " " + a.replace(" ", "  ")), F.lit(f" {b}"))
    return F.trim(F.regexp_replace(x, " +", " "))


def published() -> list[tuple[str, str]]:
    """(license id, text) of every form in which the known licences are usually published."""
    texts = [*KNOWN.items()]
    isc = "Permission to use, copy, modify, and"
    texts += [(k, KNOWN[k].replace(isc + "/or", isc, 1)) for k in ("ISC", "0BSD")]
    texts += [(k, KNOWN[k].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR", 1)) for k in ("BSD-2-Clause", "BSD-3-Clause")]
    texts += [(k, re.sub(r"\n[1-9]\. ", "\n", t)) for k, t in texts if re.search(r"\n[1-9]\. ", t)]
    texts += [(k, f"{title}\n\n{t}") for k, t in texts for title in TITLES.get(k, ())]
    for path in sorted(FULL.glob("*.txt")):
        t = path.read_text(encoding="utf-8")
        texts.append((path.stem, t))
        if cut := APPENDIX.search(t):
            texts += [(path.stem, t[: cut.start()])]
            if cut[1].startswith("END"):
                texts += [(path.stem, t[: cut.end()])]
    return texts


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """digest, license_id; of several licences with one canonical text the first by name.

    The canonical forms of ``texts``, by default of all that ``published`` has.
    """
    table = spark.createDataFrame(sorted(set(published() if texts is None else texts.items())), "license_id string, text string")
    forms = table.select("license_id", canonical().alias("form"))
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, n_words of the canonical text, license_id (null: none) for every row.

    Rows that repeat stay; an empty or null text has the digest of no text and
    no licence unless ``known`` has that digest; an empty table gives no rows;
    other columns are not read.  The texts are scanned once and not shuffled.
    """
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    form = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical().alias("form"))
    words = F.when(F.col("form") == "", 0).otherwise(F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1)
    rows = form.select("doc_id", F.sha2("form", 256).alias("digest"), words.cast("long").alias("n_words"))
    return rows.join(F.broadcast(known) if small else known, "digest", "left").select("doc_id", "digest", "n_words", "license_id")


def oracle() -> str:
    """The same by other means: lines are split and dropped one by one, spellings replaced by expressions on single-spaced words."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    lead = "^[ \t*#/;>-]*"
    states = [lead + r"copyright[ \t]*[:,]?[ \t]*([(]c[)]|©|&copy;|[12][0-9]{3}|[<\[{]|by[ \t]|yyyy)", lead + r"[(]c[)][ \t]*(copyright|©|[12][0-9]{3}|[<\[{])", lead + "©"]
    holder, body = lead + r"copyright[ \t]+[a-z]", lead + rf"copyright[ \t]+(({_PLAIN})([^a-z0-9_]|$)|the[ \t]*(\r|$))"
    stated = " OR ".join(f"regexp_matches(x, {quoted(p)})" for p in states)
    stated += f" OR (regexp_matches(x, {quoted(holder)}) AND NOT regexp_matches(x, {quoted(body)}))"

    def form(text: str) -> str:
        low = f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"
        x = f"array_to_string(list_filter(string_split({low}, chr(10)), lambda x: NOT ({stated})), chr(10))"
        x = f"replace({x}, 'all rights reserved', ' ')"
        x = f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
        for a, b in SPELLINGS:
            end = r"\b" if a.endswith(" ") else ""  # a whole word, not the beginning of one
            x = f"regexp_replace({x}, {quoted(chr(92) + 'b' + a.strip() + end)}, {quoted(b.strip())}, 'g')"
        return x

    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(set(published())))
    return f"""
WITH form AS (SELECT doc_id, {form("text")} AS form FROM documents),
known AS (SELECT sha256({form("text")}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) t(license_id, text) GROUP BY 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(form) AS digest,
  CAST(CASE WHEN form = '' THEN 0 ELSE length(form) - length(replace(form, ' ', '')) + 1 END AS BIGINT) AS n_words,
  license_id
FROM form LEFT JOIN known ON known.digest = sha256(form)"""
