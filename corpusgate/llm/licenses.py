"""Licence scans: canonical texts looked up by digest. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import sha256_hex, table
from corpusgate.llm.license_table import HEADINGS, WORDINGS, published

# The licence texts and one-line notices that the SQL counterpart knows;
# ``license_table`` adds the others.
LICENSES = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}

# Spellings treated as equal, each with the form kept.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "organisation": "organization",
    "noncommercial": "non commercial",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
}
_COPYRIGHT = r"^\s*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The lines of a text that carry wording, in one form: lower case, without
    copyright lines, every run of anything but letters and digits one space, and
    equivalent spellings alike."""
    def one(line: Column) -> Column:
        line = F.regexp_replace(line, r"[^\p{L}\p{N}]+", " ")
        line = F.concat(F.lit(" "), F.trim(line), F.lit(" "))
        for other, kept in SPELLINGS.items():
            line = F.replace(line, F.lit(f" {other} "), F.lit(f" {kept} "))
        return F.trim(line)

    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    worded = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(_COPYRIGHT)))
    return F.filter(F.transform(worded, one), lambda x: x != "")


def canonical_digest(lines: Column) -> Column:
    return sha256_hex(F.concat_ws(" ", lines))


# A line that names who holds the copyright; wording such as "copyright notice" is none.
_HOLDER = (
    r"^[\s*#/;-]*(?:(?i:copyright)\s*:?\s*(?i:\(c\)|©|[0-9]{4}|[\[<{])"
    r"|(?i:copyright)\s+(?:[Bb]y\s+)?(?!(?:Holder|Owner|Notice|Licen[cs]e|Law|Act|Treaty|Interest)s?\b)(?:\p{Lu}[\p{Ll}.]|(?i:the regents))"
    r"|©|(?i:\(c\)\s*(?:copyright\s*)?[0-9]{4})|(?i:all rights reserved)[.\s]*$)"
)
_MARKER = r"^[\s*#/;-]*(?:\(?[0-9]{1,2}[.)](?![0-9]))?\s+"
# Parts that licensees fill in or that changed over time, in canonical form.
_FILLED = [
    (r"neither the name of .{1,120}? nor the names of (?:its|their|the) contributors", "neither name nor contributors"),
    (r"software is provided by .{1,120}? as is and", "software is provided by the holder as is and"),
    (r"in no event shall .{1,120}? be liable", "in no event shall the holder be liable"),
    (r" (?:51 franklin st|59 temple pl|675 mass ave)[a-z]*(?: suite 330| fifth floor)?(?: cambridge| boston) ma [0-9 ]+(?:usa )?", " "),
    (r" https ", " http "),
]
_LEGAL = "(?i)licen[cs]e|warrant"
_SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?: (?:OR|AND|WITH) [A-Za-z0-9.+()-]+)*)"


def wording(text: Column) -> Column:
    """A text's wording in one form, however it is wrapped: without lines that name a
    holder or only a licence, list markers and what licensees fill in."""
    def plain(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.regexp_like(x, F.lit(_HOLDER)))
    lines = F.transform(lines, lambda x: plain(F.regexp_replace(F.concat(F.lit(" "), x), _MARKER, " ")))
    lines = F.filter(lines, lambda x: ~x.isin("", *HEADINGS))
    whole = F.concat(F.lit(" "), F.concat_ws(" ", lines), F.lit(" "))
    for other, kept in SPELLINGS.items():
        whole = F.replace(whole, F.lit(f" {other} "), F.lit(f" {kept} "))
    for filled, kept in _FILLED:
        whole = F.regexp_replace(whole, filled, kept)
    return F.trim(whole)


def known_wordings(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``(wording_digest, worded)`` of the given texts, a row for each wording."""
    rows = spark.createDataFrame(texts, "worded string, text string").select("worded", wording(F.col("text")).alias("w"))
    rows = rows.filter("w <> ''").select(sha256_hex(F.col("w")).alias("wording_digest"), "worded")
    return rows.groupBy("wording_digest").agg(F.min("worded").alias("worded"))


def known_licenses(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``(license_digest, license)`` of the given texts, a row for each."""
    rows = spark.createDataFrame(list(texts.items()), "license string, text string")
    lines = rows.select("license", canonical_lines(F.col("text")).alias("lines"))
    return lines.select(canonical_digest(F.col("lines")).alias("license_digest"), "license")


def scan(docs: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, n_lines, digest, license, notices)`` per document.

    ``license`` is the known licence that the entire text equals in canonical form or
    in wording, found by hash joins on digests; ``notices`` are those whose notice one
    entire line equals, whose wording stands anywhere, and SPDX identifiers, sorted and
    comma-joined. ``texts`` and ``notices`` replace all known ones. The tables are fixed
    lists, and so the only thing broadcast. Null and empty texts have no lines and
    match nothing. Equal texts get equal rows.
    """
    spark = docs.sparkSession
    given = None if texts is None else list(texts.items())
    worded = published(LICENSES) if given is None else given
    phrases = WORDINGS if notices is None else []
    texts = LICENSES | NOTICES_AS_TEXTS if texts is None else texts
    spdx = notices is None
    notices = NOTICES if notices is None else notices
    known = known_licenses(spark, texts).filter(F.col("license_digest") != F.sha2(F.lit(""), 256))
    entries = [F.array(F.lit(n), canonical_lines(F.lit(t))[0]) for n, t in sorted(notices.items())]
    text = F.col("text")
    # Every published text and every wording holds one of these words.
    legal = F.when(F.regexp_like(text, F.lit(_LEGAL)), text) if phrases and worded is not given else text
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        canonical_lines(text).alias("lines"),
        wording(legal).alias("wording"),
        F.regexp_extract_all(F.coalesce(legal, F.lit("")), F.lit(_SPDX), F.lit(1)).alias("spdx") if spdx else F.array().cast("array<string>").alias("spdx"),
    )
    padded = F.concat(F.lit(" "), F.col("wording"), F.lit(" "))
    said = [F.when(F.array_contains("lines", line[1]), line[0]) for line in entries]
    said += [F.when(padded.contains(f" {phrase} "), F.lit(name)) for name, phrase in phrases]
    found = F.concat(F.array_compact(F.array(*said)), F.col("spdx")) if said else F.col("spdx")
    read = read.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        canonical_digest(F.col("lines")).alias("digest"),
        sha256_hex(F.col("wording")).alias("wording_of"),
        F.concat_ws(",", F.array_sort(F.array_distinct(found))).alias("notices"),
    )
    joined = read.join(F.broadcast(known), F.col("digest") == F.col("license_digest"), "left")
    same = F.broadcast(known_wordings(spark, worded))
    joined = joined.join(same, F.col("wording_of") == F.col("wording_digest"), "left")
    return joined.select("doc_id", "n_lines", "digest", F.coalesce("license", "worded").alias("license"), "notices")


NOTICES_AS_TEXTS = {f"{name} notice": text for name, text in NOTICES.items()}


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op5_sql() -> str:
    line = "' ' || trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
    for other, kept in SPELLINGS.items():
        line = f"replace({line}, ' {other} ', ' {kept} ')"
    copyright_line = _COPYRIGHT.replace("\\b", "\\b")
    lines = (
        f"list_filter(list_transform(list_filter(string_split(lower(coalesce(text, '')), chr(10)), "
        f"lambda x: NOT regexp_matches(x, {_sql_text(copyright_line)})), lambda x: trim({line})), lambda x: x <> '')"
    )
    known = " UNION ALL ".join(
        f"SELECT {_sql_text(n)} AS license, {_sql_text(t)} AS text" for n, t in (LICENSES | NOTICES_AS_TEXTS).items()
    )
    notices = " UNION ALL ".join(f"SELECT {_sql_text(n)} AS license, {_sql_text(t)} AS text" for n, t in NOTICES.items())
    return f"""
WITH known AS (SELECT license, sha256(array_to_string({lines}, ' ')) AS kd FROM ({known})),
notices AS (SELECT license, ({lines})[1] AS line FROM ({notices})),
read AS (SELECT doc_id, {lines} AS lines FROM documents),
digests AS (SELECT doc_id, lines, sha256(array_to_string(lines, ' ')) AS digest FROM read)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, digest, license,
  coalesce((SELECT string_agg(n.license, ',' ORDER BY n.license) FROM notices n WHERE list_contains(lines, n.line)), '')
    AS notices
FROM digests LEFT JOIN known ON digest = kd
"""


OP5_SQL = _op5_sql()
