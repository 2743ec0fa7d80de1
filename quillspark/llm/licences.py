"""Licence scans by canonical digest lookup.

Texts and known licences are brought to one canonical form (case, punctuation, copyright lines,
equivalent spellings, white space), digested, and joined by the digest. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence guidelines call equivalent, as (pattern, form) on lower case.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("catalogue", "catalog"), ("centre", "center"), ("customisation", "customization"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelled", "labeled"), ("labelling", "labeling"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organise", "organize"), ("percent", "per cent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sublicence", "sublicense"),
    ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]


#: A line that states a copyright and no more of a licence: a sign or a year belongs to it, since a line
#: of a wrapped licence may begin with the word.
NOTICE = r"(?m)^[ \t#*/;-]*(?:\(c\)|©|copyright[^\n]*(?:\(c\)|©|[12][0-9]{3}|<year>|\[yyyy\]))[^\n]*$"
RESERVED = r"(?m)^[ \t#*/;-]*all rights reserved[ \t.]*$"


def canonical(text: Column) -> Column:
    """Lower case, copyright lines out, punctuation to spaces, single spaces, trimmed.

    A copyright line begins with "(c)" or a copyright sign, or with "copyright" and holds one of them or a
    year, or says "all rights reserved" and no more. Null stays null. The rarer steps run only on texts
    that hold what they look for. Lines are canonical one by one: a text's form is that of its
    lines, joined by spaces.
    """
    out = F.lower(text)
    lines = F.regexp_replace(F.regexp_replace(out, NOTICE, " "), RESERVED, " ")
    hints = [out.contains(x) for x in ("copyright", "(c)", "©", "all rights reserved")]
    out = F.when(hints[0] | hints[1] | hints[2] | hints[3], lines).otherwise(out)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def units(text: Column) -> Column:
    """array<struct(unit, c)>: canonical forms of a text, of its paragraphs between blank lines and of
    its lines, from one pass over the lines."""
    unit = lambda name, forms: F.transform(forms, lambda c: F.struct(F.lit(name).alias("unit"), c.alias("c")))

    def of(lines: Column) -> Column:
        own = F.transform(lines, lambda x: x["c"])
        # a newline stands for a blank line; canonical text has none
        marks = F.transform(lines, lambda x: F.when(x["blank"], "\n").otherwise(x["c"]))
        paragraphs = F.split(F.array_join(F.filter(marks, lambda x: x != ""), " "), r" *\n[ \n]*")
        document = F.array(F.array_join(F.filter(own, lambda x: x != ""), " "))
        return F.concat(unit("document", document), unit("paragraph", F.transform(paragraphs, F.trim)), unit("line", own))

    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: F.struct(canonical(x).alias("c"), x.rlike(r"^[ \t]*\z").alias("blank")))
    return F.element_at(F.transform(F.array(lines), of), 1)  # bound, so that it is made once


def one_spelling(text: Column) -> Column:
    """Canonical text with one of each pair of equivalent spellings."""
    out = text
    for said, form in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{said}\b", form)
    return F.when(text.rlike(r"\b(?:" + "|".join(x for x, _ in SPELLINGS) + r")\b"), out).otherwise(text)


def digest(text: Column) -> Column:
    return F.md5(one_spelling(canonical(text)).cast("binary"))


def known_digests(licences: DataFrame, id_col: str = "licence_id", text_col: str = "text") -> DataFrame:
    """(licence_id, digest, n), one row a digest: the smallest id of those with equal canonical texts, and
    the text's canonical length. Licences that are null, have no id or hold no letter or digit are left
    out: they would match every blank line."""
    said = canonical(F.col(text_col))
    rows = licences.where(F.col(id_col).isNotNull() & (said != "")).select(F.col(id_col).alias("licence_id"), one_spelling(said).alias("c"))
    return rows.groupBy(F.md5(F.col("c").cast("binary")).alias("digest")).agg(F.min("licence_id").alias("licence_id"), F.min(F.length("c")).cast("long").alias("n"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, unit, licence_id, n): the licences whose entire canonical text is that of a whole
    document (unit "document"), of one of its paragraphs between blank lines ("paragraph") or of one of
    its lines ("line"), and how often. A text that is a line, a paragraph and a document at once counts
    as each. known: (licence_id, digest, n) as from ``known_digests``, n the canonical length.

    Null and blank texts have no licence, and documents without one no row. Rows that repeat an id add
    up; a null id is a group of its own. An empty table on either side gives an empty result; other
    columns are ignored. Only candidates travel: a unit leaves its task as a digest, and only if its
    canonical length can be that of a known licence; equal digests of a document are counted before
    the shuffle.
    """
    sizes = [r[0] for r in known.select("n").distinct().orderBy(F.desc("n")).limit(1001).collect()]
    longest = sizes[0] if sizes else 0
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    found = rows.select("_id", F.explode(units(F.col("_text"))).alias("u")).select("_id", "u.unit", "u.c").where("c <> ''")
    # a text without a spelling to change has the known length; one with any passes: no spelling halves it
    same = F.col("c").rlike(r"\b(?:" + "|".join(x for x, _ in SPELLINGS) + r")\b") & (F.length("c") <= 2 * longest)
    if len(sizes) <= 1000:  # a list of lengths as a filter; above, their largest does
        found = found.where(F.length("c").isin(sizes) | same)
    else:
        found = found.where((F.length("c") <= longest) | same)
    found = found.groupBy("_id", "unit", F.md5(one_spelling(F.col("c")).cast("binary")).alias("digest")).agg(F.count("*").alias("n"))
    found = found.join(known.select("digest", "licence_id"), "digest").groupBy("_id", "unit", "licence_id").agg(F.sum("n").alias("n"))
    return found.select(F.col("_id").alias(id_col), "unit", "licence_id", "n")


#: Notices by which texts state a licence, and short licences whole.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]


#: Whole licences as their publishers spread them, by canonical digest and length.
WHOLE = [
    ("0BSD", "fa9583358e39e30cc008a801c940fa8c", 590),
    ("Apache-2.0-text", "431e27a103dd13fdc7f79ee287af3974", 9822),
    ("Artistic-1.0-Perl", "a8b0fb0c6e43a3b36bdc159e59dbfd1e", 5833),
    ("BSD-2-Clause-text", "b0538ec125cafeeb58bf11083985630b", 1197),
    ("BSD-3-Clause-UC", "ddcd765ed0a3236bf96e15f76c36983a", 1361),
    ("BSD-3-Clause-text", "dfd9463b7bcad50bb1270be3d6bf0c2a", 1386),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48", 6692),
    ("GFDL-1.2", "7a0a547ecac612b526676be523eacf80", 19583),
    ("GFDL-1.3", "7132e8380bc59358f27c3129a2136bf1", 22018),
    ("GPL-1.0", "9a6d41337fa0145d93e534071bfae3f8", 11766),
    ("GPL-2.0", "8e4925da11f68cc625b11b0a628fdcc5", 17118),
    ("GPL-3.0-text", "b79359b5e391fd47146ff34ae3db7ec0", 33406),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a", 24130),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4", 25217),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d", 7104),
    ("MPL-1.1", "9110e6963d47ef6ab1cb780b552357ad", 22340),
    ("MPL-2.0-text", "2a497be80529e6bc80816fd725e71003", 14272),
]


def stated(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Fixed values as a table, as one expression."""
    line = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*line)))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence_id, digest, n) of the notices, short texts and whole licences above."""
    short = known_digests(stated(spark, KNOWN, ["licence_id", "text"]))
    whole = stated(spark, WHOLE, ["licence_id", "digest", "n"]).withColumn("n", F.col("n").cast("long"))
    return short.unionByName(whole).groupBy("digest").agg(F.min("licence_id").alias("licence_id"), F.min("n").alias("n"))
