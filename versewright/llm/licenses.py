"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, without copyright lines, list numbers and punctuation, in one of the
equivalent spellings. Its SHA-256 is joined with the digests of known licences, so that a whole text that is a licence is
found whatever its layout. The known table has a few dozen rows and is broadcast, which is its proven bound; texts never
move. Lines that mention a licence are looked up in the same way as one-line notices.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Titles that licence texts have or lack, and the short notices that stand for a licence.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense"],
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
# Spellings that count as equal, the second for the first. They stand between spaces.
SPELLINGS = [
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("authorisation", "authorization"), ("behaviour", "behavior"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("organisations", "organizations"), ("per cent", "percent"),
    ("recognise", "recognize"), ("recognised", "recognized"), ("whilst", "while"), ("wilful", "willful"),
]
# The same within words.
STEMS = [("licenc", "licens")]
# Both patterns mean the same to Java and to RE2.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[<{\[]|the regents)|(\(c\)|©)[ \t]*[0-9]{4}|all rights reserved)[^\n]*"
)
LIST_NUMBER = r"(^|\n)[ \t*#/;-]*\(?[0-9]{1,2}[.)][ \t]+"
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form, words between single spaces with one at both ends; null for null."""
    form = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    form = F.regexp_replace(form, LIST_NUMBER, "\n")
    form = F.concat(F.lit(" "), F.trim(F.regexp_replace(form, PUNCTUATION, " ")), F.lit(" "))
    for stem, same in STEMS:
        form = F.replace(form, F.lit(stem), F.lit(same))
    for spelling, same in SPELLINGS:
        form = F.replace(form, F.lit(f" {spelling} "), F.lit(f" {same} "))
    return form


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def license_texts() -> list[tuple[str, str]]:
    """``(licence, text)`` of the packaged licences, with and without their titles."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            body = f.read()
        licence = name.removesuffix(".txt")
        out += [(licence, body), *((licence, f"{title}\n\n{body}") for title in TITLES.get(licence, ()))]
    return out


def notice_texts() -> list[tuple[str, str]]:
    return [(licence, text) for licence, texts in NOTICES.items() for text in texts]


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license, digest`` of licence texts, by default the packaged ones; equal digests once, under the first name."""
    rows = spark.createDataFrame(license_texts() if texts is None else texts, "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, known: DataFrame | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with ``license_digest``, ``license`` and ``license_notices``.

    ``license`` is the licence that the whole text is, null if it is none; ``license_notices`` the sorted licences that its
    lines name. A null text has a null digest and no notices; empty texts and texts of punctuation alone have the digest
    of an empty form and are no licence. Rows are looked up one by one, so repeated rows get equal results, and an empty
    table gives an empty one. Columns named like a result are replaced. ``known (license, digest)`` is broadcast: it must
    be as small as a table of licences is.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    known = known.select(F.col("digest").alias("__known_digest"), F.col("license").alias("__known_license"))
    base = docs.drop("license_digest", "license", "license_notices").withColumn("license_digest", digest(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike("licen[cs]e"))
    named = lambda d: F.coalesce(F.lit(None).cast("string"), *[
        F.when(d == digest(F.lit(text)), F.lit(licence)) for licence, text in sorted(notice_texts() if notices is None else notices)])
    found = F.transform(F.transform(lines, digest), named)
    rows = base.join(F.broadcast(known), F.col("license_digest") == F.col("__known_digest"), "left")
    names = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return rows.select(
        *base.columns, F.col("__known_license").alias("license"),
        F.coalesce(names, F.array().cast("array<string>")).alias("license_notices"))


def _sql_form(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
    form = f"regexp_replace({form}, {quote(LIST_NUMBER)}, chr(10), 'g')"
    form = f"' ' || trim(regexp_replace({form}, {quote(PUNCTUATION)}, ' ', 'g')) || ' '"
    for stem, same in STEMS:
        form = f"replace({form}, '{stem}', '{same}')"
    for spelling, same in SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {same} ')"
    return f"sha256({form})"


def scan_sql() -> str:
    """The query over ``documents`` for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""WITH texts(license, text) AS (VALUES {values(license_texts())}),
known AS (SELECT {_sql_form("text")} AS digest, min(license) AS license FROM texts GROUP BY 1),
short(license, text) AS (VALUES {values(notice_texts())}),
notices AS (SELECT {_sql_form("text")} AS digest, min(license) AS license FROM short GROUP BY 1),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(lower(line), 'licen[cs]e')),
named AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS license_notices
  FROM (SELECT doc_id, {_sql_form("line")} AS digest FROM lines) JOIN notices USING (digest) GROUP BY doc_id),
own AS (SELECT doc_id, {_sql_form("text")} AS license_digest FROM documents)
SELECT own.doc_id, license_digest, known.license AS license, coalesce(license_notices, []) AS license_notices
FROM own LEFT JOIN known ON license_digest = known.digest LEFT JOIN named USING (doc_id)"""
