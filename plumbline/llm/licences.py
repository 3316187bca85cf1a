"""Licence scans by canonical digests: normalise a whole text, hash it, and join with the digests of known licences.

Copies of a licence differ in case, punctuation, line breaks, the copyright line and a few spellings. The canonical form has none of
these, so equal digests mean the same licence. Short notices are texts like any other: a document is looked up whole and line by line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, columns, small_side

# fixed values: spellings that licence texts use for the same word
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright holder", "copyright owner"))

# fixed values: one-line notices and short licences, by SPDX name
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)

COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*\b[0-9]{4}\b[^\n]*$|^[ \t]*all rights reserved\.?[ \t]*\r?$"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with letters and digits only, single blanks, and one spelling of each word."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for null texts and for those of which nothing is left."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_licences(spark: SparkSession, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """``(digest, licence)``: a table of known texts; the smallest name stands where two share a digest."""
    table = spark.createDataFrame(list(notices), "licence string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "licence").where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, licences: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, licence, n_notices, notices)``: one row per row of ``docs``.

    ``licence`` is that of the whole text or null, ``n_notices`` the lines that are a known text by themselves, ``notices`` their licences in
    order of name. ``licences (digest, licence)`` may be of any size: it is broadcast only if it fits the session's bound. Null and
    empty texts have a null digest. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        known = columns(licences, digest="digest", licence="licence").where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))
        known = scratch.keep(known.select(F.unhex("digest").alias("digest"), "licence"), release=True)
        table = small_side(known, known.count(), 128)
        lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.unhex(digest(x))), lambda x: x.isNotNull())
        given = columns(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
        rows = scratch.keep(given.select("row", "doc_id", F.unhex(digest(F.col("text"))).alias("digest"), lines.alias("lines")), release=True)
        found = rows.select("row", F.explode("lines").alias("digest")).join(table, "digest")
        hits = scratch.keep(found.groupBy("row").agg(F.count("*").alias("n_notices"), F.sort_array(F.collect_set("licence")).alias("notices")), release=True)
    out = rows.drop("lines").join(table, "digest", "left").join(hits, "row", "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", empty).alias("notices"))
