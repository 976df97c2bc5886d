"""Licence texts: a canonical form of a whole text, its digest, and a join with the digests of known licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, and spellings that count as one.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = {
    "MIT": [MIT, MIT.partition("\n")[2]],
    "BSD-2-Clause": [BSD_TOP + BSD_END, "BSD 2-Clause License\n" + BSD_TOP + BSD_END],
    "BSD-3-Clause": [BSD_TOP + BSD_NAMES + BSD_END, "BSD 3-Clause License\n" + BSD_TOP + BSD_NAMES + BSD_END],
    "ISC": [ISC, ISC.partition("\n")[2]],
    "Unlicense": [UNLICENSE],
}
#: Notices: one line that puts a text under a licence.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
}
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("copyright holders", "copyright holder")]

#: A line that only states a copyright: it differs from copy to copy and is left out. It begins with the word and its sign,
#: with the sign alone, with `(c)` or the word and a year anywhere, or with "copyright by"; or it says "all rights reserved"
#: and no more. Wrapped lines of a licence that begin with the word ("copyright notice, this list ...") are none of these.
YEAR = r"(?:[^\n]*[^0-9\n])?(?:19|20)[0-9]{2}(?:[^0-9\n][^\n]*)?"
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}©(\n]*(?:copyright[^\p{L}\n(]*(?:\(c\)|©)[^\n]*|©[^\n]*|\(c\)" + YEAR + "|copyright" + YEAR
    + r"|copyright by [^\n]*|(?:\(c\) ?)?all rights reserved[^\p{L}\n]*)$"
)


#: In every known notice, and so in every line that can be one.
NOTICE_WORD = "(?i)licen[cs]e"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters and digits joined by one space, one spelling of each word."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    # Two blanks between words, so that each has its own before and behind it.
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for one, other in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    return F.trim(F.replace(plain, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """`(license_id, digest)` of texts by licence; the first licence keeps a digest that two share."""
    if not all(re.search(NOTICE_WORD, line) for line in ([] if texts is KNOWN else sum(texts.values(), []))):
        raise ValueError("a notice without the word that marks notices")
    rows = spark.createDataFrame([(k, t, i) for i, (k, many) in enumerate(texts.items()) for t in many], "license_id string, text string, place int")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min_by("license_id", "place").alias("license_id"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """`(doc_id, digest, license_id, notices)` of every row: the digest of the canonical form of its whole text, the
    licence whose text that is (null if none), and the sorted licences of its notice lines.

    A line is looked at whole as well, by the same form and digest. Only lines with a word that all known notices share
    are joined, so few rows are shuffled. Null and empty texts have the digest of the empty form and no licence; rows
    alike in id and text share their notices; extra columns are not read.
    """
    spark = docs.sparkSession
    licenses = known_licenses(spark, KNOWN) if licenses is None else licenses
    notices = known_licenses(spark, NOTICES) if notices is None else notices
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_hash"), digest(F.col(text_col)).alias("digest"))
    named = rows.join(licenses, "digest", "left")
    marked = docs.where(F.col(text_col).rlike(NOTICE_WORD)).select(F.col(id_col).alias("id"), key.alias("hash"), F.explode(F.split(text_col, "\n")).alias("line"))
    lines = marked.where(F.col("line").rlike(NOTICE_WORD)).select("id", "hash", digest(F.col("line")).alias("digest"))
    found = lines.join(notices, "digest").groupBy("id", "hash").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    none = F.array().cast("array<string>")
    return named.join(found, match, "left").select("doc_id", "digest", "license_id", F.coalesce("notices", none).alias("notices"))

