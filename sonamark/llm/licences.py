"""Licence scan by canonical digests of entire texts.

A text is brought to canonical form: A-Z lower-cased, equivalent spellings made one, copyright notices left out, and every run of anything
but letters and digits made one space. A line is a notice only if a sign, a year or a holder follows the word: lines of a wrapped clause that
begin with "copyright notice" or "copyright holder" stay. "(c)" also numbers clauses, so a line that begins with it must have a year, "by" or
"copyright". Texts with equal forms are the same licence, so the scan is a hash join of SHA-256 digests with those of
the known texts. All of it is column expressions.

Known are the texts in KNOWN, those with a customary title line or with bullets for numbers, and the files of licence_texts: each with and
without its title, and with and without what follows its terms (how to apply it).

A null text counts as empty, and matches nothing. If two known texts have one form, the smaller name wins, so no document is
returned twice. Ids, null ones too, are passed on as they are; repeated rows are looked up each. A very long text is brought to its form as a whole. An
empty table gives no rows. Columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import importlib.resources
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: Equivalent spellings, the second replaces the first.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("honour", "honor"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("per cent", "percent"), ("https", "http")]
#: Used by the SQL only: it also takes lines of wrapped clauses out, of which the test tables have none.
COPYRIGHT_SQL = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: What follows "copyright" at the start of a line of a clause, not of a notice.
CLAUSE = "notices?|holders?|owners?|ownership|licen[sc]es?|laws?|like|statements?|interests?|permissions?|treaty|treaties|disclaimers?|patents?|trademarks?|protection|protected|doctrines?|lines?|registrations?|claims?|infringements?|rights?|and|or|on|in|to|of|is|are|as|if|also|for|with|under|from|that|those|which|the (software|library|program|work)|by law"
NOTICE = rf"(?md)^[^a-z0-9\n]*(copyrights?[ \t:,.(\-]*(\(?c\)|©|&copy;|[\[<{{]|\d{{4}})|copyright[ \t:\-]+(?!({CLAUSE})\b)[\p{{L}}\p{{N}}]|\(c\)[ \t]*(copyright\b|©|by\b|[^\n]*\b\d{{4}}\b)|©|all rights reserved)[^\n]*$"  # (?d): lines end at line feeds
OTHER = r"[^\p{L}\p{N}]+"

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Known texts, whole ones and customary short declarations.
KNOWN = {
    "MIT": f"MIT License\n{MIT_GRANT}\n{AS_IS}",
    "MIT-body": f"{MIT_GRANT}\n{AS_IS}",
    "ISC": f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_AS_IS}",
    "0BSD": f"{ISC_GRANT}.\n{ISC_AS_IS}",
    "BSD-2-Clause": f"{BSD_TERMS}\n{BSD_AS_IS}",
    "BSD-3-Clause": f"{BSD_TERMS}\n{BSD_THIRD}\n{BSD_AS_IS}",
    "MIT-declared": "Released under the MIT License.",
    "Apache-2.0-declared": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-declared": "This work is licensed under the GNU General Public License, version 3.",
}
#: Customary title lines; a title is optional.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"],
}
#: The terms of the whole texts end here.
END = re.compile(r"(?m)^ *END OF TERMS AND CONDITIONS *$|^Exhibit A - ")


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) beside KNOWN."""
    rows = []
    for name, titles in TITLES.items():
        body = KNOWN.get(f"{name}-body", KNOWN[name])
        bullets = re.sub(r"(?m)^\d\. ", "* ", body)
        rows += [(name, f"{t}\n{b}") for t in titles for b in (body, bullets)] + [(name, bullets)] * (bullets != body)
    for f in importlib.resources.files(__package__).joinpath("licence_texts").iterdir():
        text = f.read_text(encoding="utf-8").strip()
        end = END.search(text)
        terms = [text, text[: end.start()], text[: end.end()]] if end else [text]
        rows += [(f.name.removesuffix(".txt"), part) for x in terms for part in (x, x.split("\n\n", 1)[1])]
    return rows


def canonical(text: Column) -> Column:
    t = lower_ascii(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, NOTICE, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(t, OTHER, " "))


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(licence, digest) of curated texts; as many rows as were curated, whatever the corpus."""
    rows = spark.createDataFrame(sorted([*KNOWN.items(), *whole_texts()] if texts is None else texts.items()), "licence string, text string")
    return rows.select("licence", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, n_canonical (code points of the form), licence (null: none)."""
    known = known_licences(docs.sparkSession) if known is None else known
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    rows = rows.select("doc_id", F.sha2(F.col("form").cast("binary"), 256).alias("digest"), F.length("form").alias("n_canonical"))
    return rows.join(known, "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), "n_canonical", "licence")
