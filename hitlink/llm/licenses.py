"""Operator 4: licence scan by canonical digests.

A text is brought into canonical form: A-Z in lower case, copyright lines removed, punctuation and white space to one
space, equivalent spellings to one. The SHA-256 digest of an entire unit is then looked up among the digests of the
known licences, which went through the same steps. Units are the whole text, its blocks (runs of lines without a blank
one) and its lines, so a licence is found when it is the document, a paragraph of it or a notice line.

At scale: expressions in one scan; digests of units meet the known digests in a broadcast join (the table of licences is
the caller's, some hundred rows; above ``broadcast_rows`` a shuffled join is left to Spark). Only matches are grouped by
document, so neither texts nor digests of all documents are shuffled.

Null and empty texts and texts without a letter or digit match nothing and have a null digest. Rows that repeat an id
are one document: the matches of all its rows, the largest digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlink.llm.common import LOWER, UPPER, ascii_lower, documents

# Licence names with the texts that are looked up, and spellings that count as one.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
]
SPELLINGS = [("licence", "license"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"),
             ("per cent", "percent"), ("non commercial", "noncommercial"), ("sub license", "sublicense"),
             ("copyright owner", "copyright holder"), ("fulfil ", "fulfill ")]
# A line that begins with a copyright mark, comment signs before it allowed, and the line break before it.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright [(0-9]|copyright ©|\(c\) |©)[^\n]*"
NOISE = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLANK_LINES = r"\n[ \n]*\n"


def canonical(c: Column) -> Column:
    """Canonical form with its line breaks."""
    c = F.regexp_replace(ascii_lower(c), COPYRIGHT_LINE.replace("\\u00A9", "©"), "")
    c = F.regexp_replace(c, NOISE, " ")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \n]+", " "))


def digest(c: Column) -> Column:
    return F.when(c != "", F.sha2(c.cast("binary"), 256))


def license_scan(df: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text",
                 broadcast_rows: int = 20_000) -> DataFrame:
    """``digest`` and ``license`` of the whole text, ``notices`` (licences of blocks and lines, sorted, comma-joined) and
    ``n_notices`` (blocks and lines that are a known text, a block of one line once) of every document."""
    spark, known = df.sparkSession, KNOWN if known is None else known
    names = spark.createDataFrame(known or [("", "")], "license string, text string")
    names = (names.select(digest(one_line(canonical(F.col("text")))).alias("digest"), "license")
             .where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license")))
    if len(known) <= broadcast_rows:
        names = F.broadcast(names)
    docs = documents(df, id_col, text_col).select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("canonical"))
    whole = docs.groupBy("doc_id").agg(F.max(digest(one_line(F.col("canonical")))).alias("digest"))

    def units_of(text: Column) -> Column:
        blocks = F.filter(F.split(text, BLANK_LINES), lambda b: F.instr(F.btrim(b, F.lit(" \n")), "\n") > 0)
        return F.concat(blocks, F.split(text, "\n"))

    # A lambda's variable is computed once; the column itself would be, in full, for each place that names it.
    units = F.flatten(F.transform(F.array("canonical"), units_of))
    found = (docs.select("doc_id", F.explode(units).alias("unit"))
             .select("doc_id", digest(one_line(F.col("unit"))).alias("digest")).join(names, "digest")
             .groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")))
    found = found.withColumnRenamed("doc_id", "found_id")
    return (whole.join(names, "digest", "left").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
            .select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
                    F.coalesce("notices", F.lit("")).alias("notices")))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(c: str) -> str:
        c = f"translate({c}, '{UPPER}', '{LOWER}')"
        c = f"regexp_replace({c}, {text(COPYRIGHT_LINE.replace(chr(92) + 'u00A9', chr(0xA9)))}, '', 'g')"
        c = f"regexp_replace({c}, {text(NOISE)}, ' ', 'g')"
        for old, new in SPELLINGS:
            c = f"replace({c}, {text(old)}, {text(new)})"
        return c

    line = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    rows = ", ".join(f"({text(n)}, {text(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (SELECT sha256({line(canon('t'))}) AS digest, min(license) AS license FROM (VALUES {rows}) v(license, t) GROUP BY 1),
docs AS (SELECT doc_id, {canon("coalesce(text, '')")} AS c FROM documents),
whole AS (SELECT doc_id, CASE WHEN {line('c')} <> '' THEN sha256({line('c')}) END AS digest FROM docs),
units AS (
  SELECT doc_id, unnest(list_concat(list_filter(string_split_regex(c, '\\n[ \\n]*\\n'), lambda x: contains(trim(x, ' ' || chr(10)), chr(10))),
                                    string_split(c, chr(10)))) AS unit FROM docs),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM units JOIN known ON sha256({line('unit')}) = digest GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(f.n, 0) AS n_notices, coalesce(f.names, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id
"""


ORACLE = _sql()


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
