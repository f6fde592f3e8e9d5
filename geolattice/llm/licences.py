"""Operator 2: licence texts found by the digest of their canonical form.

Canonical form: lower case; runs of anything but letters, digits and line ends become a
blank; equivalent spellings become one; lines that only state a copyright go; lines are
joined.  A line states a copyright if it begins with the word, the sign or "c" and a
year, doesn't go on as licence texts do ("copyright notice", "copyright holders"), and
has at most 25 words.  A text is a known licence if the MD5 digests of the canonical
forms are equal.  Both the whole of each document and each of its lines is looked up,
since a document may be a licence or carry one in a line.

Known are the texts in `licence_texts` (short licences as texts, long ones by digest)
and the one-sentence notices below; `known` takes others.

Plan: JVM expressions only.  The texts are read once, lines are exploded into digests
and joined to the table of known digests, which is broadcast: it is a list in this
library or of the caller, not a table that grows with the corpus (beyond `MOST_KNOWN`
entries the planner decides).  Nothing is shuffled.

Defined results: null texts, and texts and lines whose canonical form is empty, match
nothing; a document of one line that is a licence is found as document and as line; a
licence that stands in one line with its copyright isn't found; a digest that several
licences share is the least of them; repeated rows are found each; an empty table gives
no rows; other columns are not read; very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm._store import documents
from geolattice.llm.licence_texts import DIGESTS, TEXTS

MOST_KNOWN = 100_000
#: Licence and a text that stands for it.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]

#: Spellings that mean the same, in canonical form between blanks.
SPELLINGS = [("licenc", "licens"), (" non commercial", " noncommercial"), (" share alike", " sharealike"), (" sub licens", " sublicens"), (" copyright owner", " copyright holder"), (" gnu gpl ", " gnu general public license "), (" creativecommons ", " creative commons "), (" apache 2 0 license ", " apache license version 2 0 "), (" merchantibility", " merchantability"), (" acknowledgement ", " acknowledgment "), (" https ", " http ")]
_VERSION = r" (version|ver|v) ?([0-9])"
_COPYRIGHT = r"^((some |all )?portions )?(spdx filecopyrighttext|copyright|c ((19|20)[0-9]{2}|copyright))( |$)"
#: How lines of licence texts go on that begin with "copyright".
_TEXT = r"^copyright (also|lines?|notices?|holders?|licens[a-z]*|laws?|and|or|nor|interests?|in|is|are|on|to|as|for|of|statements?|disclaimers?|claims?|protection|permission|treat[a-z]*|status|assignments?|infringement|office|act|rights?|patents?|that|which|if|may|must|shall|should|will|does|do|can|has|have|you|this|these)( |$)"
_SHORT = r"^([^ ]+ ){0,24}[^ ]+$"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line, in order."""
    x = F.regexp_replace(F.replace(F.lower(text), F.lit("©"), F.lit(" c ")), r"[^\p{L}\p{N}\n]+", " ")
    x = F.concat(F.lit(" "), F.replace(x, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, _VERSION, " version $2")
    return F.transform(F.split(x, "\n", -1), lambda y: F.trim(F.replace(F.replace(y, F.lit("   "), F.lit(" ")), F.lit("  "), F.lit(" "))))


def canonical(lines: Column) -> Column:
    """Canonical form of a whole text from those of its lines."""
    return F.concat_ws(" ", F.filter(lines, lambda y: (y != "") & ~(y.rlike(_COPYRIGHT) & ~y.rlike(_TEXT) & y.rlike(_SHORT))))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, licence of those given, else of all in this library."""
    if texts is None and digests is None:
        texts, digests = NOTICES + TEXTS, DIGESTS
    rows = spark.createDataFrame(texts or [], "licence string, text string").withColumn("lines", canonical_lines(F.col("text")))
    own = rows.select("licence", canonical(F.col("lines")).alias("t")).filter("t <> ''").select(F.md5("t").alias("digest"), "licence")
    out = own.unionByName(spark.createDataFrame([(d, name) for name, d in digests or []], "digest string, licence string")).groupBy("digest").agg(F.min("licence").alias("licence"))
    return F.broadcast(out) if len(texts or []) + len(digests or []) <= MOST_KNOWN else out


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part ('document' or 'line'), line_no (from 1; 0 for the document), licence."""
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    units = F.concat(F.array(F.when(F.size("lines") > 0, canonical(F.col("lines")))), F.col("lines"))
    digests = F.transform(units, lambda u: F.when(u != "", F.md5(u)))
    return (
        rows.select("id", F.posexplode(digests).alias("line_no", "digest")).filter("digest is not null").join(licences, "digest")
        .select(F.col("id").alias(id_col), F.when(F.col("line_no") == 0, "document").otherwise("line").alias("part"), "line_no", "licence")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licence texts in the whole table."""
    return scan(documents(spark, sf_dir), known(spark))


def _sql_lines(text: str) -> str:
    x = f"regexp_replace(replace(lower({text}), '©', ' c '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    x = f"(' ' || replace({x}, chr(10), ' ' || chr(10) || ' ') || ' ')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '{_VERSION}', ' version \\2', 'g')"
    return f"list_transform(string_split({x}, chr(10)), lambda y: trim(replace(replace(y, '   ', ' '), '  ', ' '), ' '))"


def _sql_whole(lines: str) -> str:
    return f"array_to_string(list_filter({lines}, lambda y: y <> '' AND NOT (regexp_matches(y, '{_COPYRIGHT}') AND NOT regexp_matches(y, '{_TEXT}') AND regexp_matches(y, '{_SHORT}'))), ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in NOTICES + TEXTS)
_DIGESTS = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in DIGESTS)
QUERY = "op2_licence_scan"
SQL = f"""
WITH texts AS (SELECT licence, {_sql_lines('t')} AS ls FROM (VALUES {_VALUES}) v(licence, t)),
known AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, md5({_sql_whole('ls')}) AS digest FROM texts UNION ALL SELECT * FROM (VALUES {_DIGESTS}) d(licence, digest)) GROUP BY 1),
docs AS (SELECT doc_id, {_sql_lines('text')} AS ls FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(list_concat([{_sql_whole('ls')}], ls)) AS u, unnest(range(len(ls) + 1)) AS line_no FROM docs)
SELECT doc_id, CASE WHEN line_no = 0 THEN 'document' ELSE 'line' END AS part, CAST(line_no AS INTEGER) AS line_no, licence
FROM units JOIN known ON md5(u) = digest WHERE u <> ''
"""
