"""Licence scan in DataFrame operations: TF-IDF cosine of statements to templates, then inheritance down directories.

Where the hinted lines together resemble no template, and in all licence files, parts of the text are compared with
standard headers and full licence texts as well: each hinted line, windows of words around the hints, and licence files
whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import FULL, HEADERS
from .tables import stored

# Wording that licence headers and files use (fixed values).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
)
# Lines that may state a licence: they hold one of these, in either case.
HINTS = ("license", "licence", "creative commons", "public domain", "redistribution", "copyright", "spdx")
WORD = "[a-z0-9.]*[a-z0-9]"
THRESHOLD = 0.5
# What parts of a text are compared with, several a licence.
TEXTS = (*TEMPLATES, *HEADERS, *FULL)
NAMES = tuple(sorted({name for name, _ in TEXTS}))
# Words of a window; windows start at every quarter of their size and hold a word with a hint.
WINDOWS = (6, 12, 24, 48, 96, 192)
HINT_WORD = "licen[cs]e|commons|domain|redistribution|copyright|spdx"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.-]+?)(?:-only|-or-later|[+])?(?![a-z0-9.+-])"
# Names of files that speak for their directory.
FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def statement(text: Column) -> Column:
    """The lines of a whole text that may state a licence; null if there are none."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: _hinted(F.lower(line)))
    return F.when(_hinted(F.lower(text)), F.array_join(lines, "\n"))


def _hinted(low: Column) -> Column:
    return reduce(or_, (low.contains(hint) for hint in HINTS))


def _vectors(terms: DataFrame, key: str, weights: DataFrame, n: int) -> DataFrame:
    """(key, term, weight) with unit length; terms: (key, term) over ``n`` templates."""
    counted = terms.groupBy(key, "term").agg(F.count("*").alias("tf")).join(weights, "term", "left")
    # A term of no template adds length only, with the weight of a term that is in none.
    raw = counted.select(key, "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0 + _log(n + 1)))).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def _log(x: float) -> float:
    import math

    return math.log(x)


def _nearest(terms: DataFrame, key: str, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(key, licence, similarity): the template most similar to the terms of each key, the first by name on a tie."""
    n = len(templates)
    made = terms.sparkSession.createDataFrame([(k, *t) for k, t in enumerate(templates)],
                                              "template int, licence string, wording string")
    wording = made.select("template", F.explode(words(F.col("wording"))).alias("term"))
    weights = wording.distinct().groupBy("term").agg(
        (F.log(F.lit(n + 1.0) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    known = _vectors(wording, "template", weights, n).withColumnRenamed("weight", "other")
    said = _vectors(terms, key, weights, n)
    scored = said.join(F.broadcast(known), "term").groupBy(key, "template").agg(
        F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("similarity"))
    best = scored.where(F.col("similarity") >= threshold).join(
        F.broadcast(made.select("template", "licence")), "template").groupBy(key).agg(
        F.min(F.struct((-F.col("similarity")).alias("minus"), "licence")).alias("best"))
    return best.select(key, F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("similarity"))


def classify(statements: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(statement, licence, similarity) of the statements that resemble a template: the most similar one, the first by
    name on a tie."""
    return _nearest(statements.select("statement", F.explode(words(F.col("statement"))).alias("term")), "statement",
                    TEMPLATES, threshold)


def classify_parts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(body, whole, licence, similarity) of texts (body, whole, text) with a part that resembles one of TEXTS.

    An SPDX identifier of a known licence counts before all; then the most similar part. The whole text is a part only
    if ``whole`` is set. Windows are made by equi-joins on their numbers, so a text costs its words a constant number of
    times however many hints it has.
    """
    said = F.lower(F.regexp_extract("text", SPDX, 1))
    names = F.create_map(*(F.lit(x) for name in NAMES for x in (name.lower(), name)))
    spdx = texts.select("body", "whole", F.element_at(names, said).alias("licence"), F.lit(-2.0).alias("minus")).where(
        "licence is not null")
    word = texts.select("body", "whole", F.posexplode(words(F.col("text"))).alias("at", "term"))
    line = texts.select("body", "whole", F.posexplode(F.split(statement(F.col("text")), "\n", -1)).alias("at", "line"))
    lines = line.select("body", "whole", F.lit(1).alias("size"), F.col("at").cast("bigint").alias("first"),
                        F.explode(words(F.col("line"))).alias("term"))
    full = word.where("whole").select("body", "whole", F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("first"), "term")
    sizes = F.explode(F.array(*(F.lit(n) for n in WINDOWS)))
    starts = F.explode(F.transform(F.array(*(F.lit(k) for k in range(4))), lambda k: F.floor(F.col("at") * 4 / F.col("size")) - k))
    placed = word.withColumn("size", sizes).withColumn("first", starts).where("first >= 0")
    window = ["body", "whole", "size", "first"]
    hinted = placed.where(F.col("term").rlike(HINT_WORD)).select(*window).distinct()
    parts = placed.join(hinted, window, "left_semi").select(*window, "term").unionByName(lines).unionByName(full)
    near = _nearest(parts.select(F.struct(*window).alias("part"), "term"), "part", TEXTS, threshold)
    found = near.select("part.body", "part.whole", "licence", (-F.col("similarity")).alias("minus")).unionByName(spdx)
    best = found.groupBy("body", "whole").agg(F.min(F.struct("minus", "licence")).alias("best"))
    return best.select("body", "whole", F.col("best.licence").alias("licence"),
                       F.least(F.lit(1.0), -F.col("best.minus")).alias("similarity"))


def _directories(path: Column) -> Column:
    """Every directory above a path, the nearest first, with how many steps away it is."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), depth), lambda up: F.struct(
        F.array_join(F.slice(parts, 1, depth - up), "/").alias("directory"), up.alias("steps")))


def scan(files: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: key, path, licence, found ('header', 'file', 'inherited' or null), similarity.

    files: ``key``, path, text. A file's own statement counts first. One without takes the licence of the nearest
    directory above it whose licence file (LICENSE, COPYING, NOTICE) has one; of several in a directory the most
    similar, then the first by licence. Equal statements are compared once, wherever they occur. Null or empty texts
    state nothing, a null path inherits nothing; rows with equal ``key`` and path are each answered from their own
    statement. An empty table gives no rows.
    """
    # Texts are read once; everything below works on paths, statements and the texts that have one.
    said = statement(F.col("text"))
    name = F.element_at(F.split("path", "/", -1), -1)
    noted = stored(files.select(
        key, "path", said.alias("statement"), F.coalesce(name.rlike(FILE), F.lit(False)).alias("is_file"),
        F.when(said.isNotNull(), F.col("text")).alias("text"), F.when(said.isNotNull(), F.xxhash64("text")).alias("body")),
        "statements")
    # Most files state nothing: they stay out of the joins, where they would be one key.
    silent = noted.where(F.col("statement").isNull()).select(
        key, "path", "is_file", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("similarity"))
    stating = noted.where(F.col("statement").isNotNull())
    own = classify(stating.select("statement").distinct(), threshold)
    first = stored(stating.join(own, "statement", "left").select(
        key, "path", "is_file", "text", "body", "licence", "similarity"), "first")
    # Copies of a text are compared once.
    open_ = first.where(F.col("is_file") | F.col("licence").isNull())
    parts = classify_parts(open_.select("body", F.col("is_file").alias("whole"), "text").dropDuplicates(["body", "whole"]),
                           threshold).select("body", F.col("whole").alias("is_file"), F.col("licence").alias("other"),
                                             F.col("similarity").alias("closer"))
    better = F.col("closer").isNotNull() & (F.col("similarity").isNull() | F.col("is_file") & (
        F.col("closer") > F.col("similarity")))
    seen = first.drop("text").join(parts, ["body", "is_file"], "left").select(
        key, "path", "is_file", F.when(better, F.col("other")).otherwise(F.col("licence")).alias("licence"),
        F.when(better, F.col("closer")).otherwise(F.col("similarity")).alias("similarity")).unionByName(silent)
    seen = stored(seen, "licences")
    granted = seen.where(F.col("is_file") & F.col("licence").isNotNull()).select(
        F.element_at(_directories(F.col("path")), 1)["directory"].alias("directory"), "licence", "similarity"
    ).groupBy("directory").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "licence")).alias("grant"))
    # Directories, not files, climb: a directory is looked up once however many files it has.
    folder = F.element_at(_directories(F.col("path")), 1)["directory"]
    needy = seen.where(F.col("licence").isNull()).select(folder.alias("folder")).where("folder is not null").distinct()
    climbed = needy.select("folder", F.explode(_directories(F.concat("folder", F.lit("/")))).alias("above")).select(
        "folder", "above.directory", "above.steps")
    nearest = climbed.join(granted, "directory").groupBy("folder").agg(
        F.min(F.struct("steps", "grant.licence", F.col("grant.minus").alias("minus"))).alias("near"))
    placed = seen.withColumn("folder", folder).join(nearest, "folder", "left")
    inherited = F.col("licence").isNull() & F.col("near").isNotNull()
    return placed.select(
        key, "path",
        F.coalesce("licence", "near.licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header"))
        .when(inherited, "inherited").alias("found"),
        F.coalesce(F.col("similarity"), -F.col("near.minus")).alias("similarity"))


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: the documents of a source as a tree of directories of 400 and of 40, one LICENSE in each of
    the smaller ones and one NOTICE in each of the larger."""
    number = F.col("doc_id").cast("bigint")
    name = (F.when(number % 400 == 1, "NOTICE").when(number % 40 == 0, "LICENSE")
            .otherwise(F.concat(number.cast("string"), F.lit(".txt"))))
    small = F.when(number % 400 == 1, F.lit("")).otherwise(F.concat(F.floor(number / 40).cast("string"), F.lit("/")))
    return docs.select(number.alias("doc_id"), F.concat("source", F.lit("/"), F.floor(number / 400).cast("string"),
                                                        F.lit("/"), small, name).alias("path"), "text")


_VALUES = ", ".join("('{}', '{}')".format(*t) for t in TEMPLATES)
ORACLE_SQL = f"""
WITH templates(licence, wording) AS (VALUES {_VALUES}),
files AS (
  SELECT doc_id, source || '/' || CAST(doc_id // 400 AS VARCHAR) || '/' ||
    CASE WHEN doc_id % 400 = 1 THEN 'NOTICE'
         WHEN doc_id % 40 = 0 THEN CAST(doc_id // 40 AS VARCHAR) || '/LICENSE'
         ELSE CAST(doc_id // 40 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path, text
  FROM documents),
noted AS (
  SELECT doc_id, path, array_to_string(list_filter(string_split(text, chr(10)),
    lambda l: regexp_matches(lower(l), '{"|".join(HINTS)}')), chr(10)) AS statement
  FROM files),
words AS (
  SELECT 't' AS side, licence AS name, unnest(regexp_extract_all(lower(wording), '{WORD}')) AS term FROM templates
  UNION ALL
  SELECT 's', statement, unnest(regexp_extract_all(lower(statement), '{WORD}'))
  FROM (SELECT DISTINCT statement FROM noted WHERE statement <> '')),
idf AS (
  SELECT term, ln({len(TEMPLATES) + 1}.0 / (1 + count(DISTINCT name))) + 1.0 AS idf
  FROM words WHERE side = 't' GROUP BY term),
raw AS (
  SELECT side, name, w.term, count(*) * coalesce(any_value(idf), 1.0 + ln({len(TEMPLATES) + 1}.0)) AS w
  FROM words w LEFT JOIN idf ON w.term = idf.term GROUP BY side, name, w.term),
unit AS (SELECT side, name, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, name)) AS w FROM raw),
scored AS (
  SELECT s.name AS statement, t.name AS licence, round(sum(s.w * t.w), 6) AS similarity
  FROM unit s JOIN unit t ON s.term = t.term AND s.side = 's' AND t.side = 't' GROUP BY 1, 2),
own AS (
  SELECT statement, licence, similarity FROM scored WHERE similarity >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY statement ORDER BY similarity DESC, licence) = 1),
seen AS (
  SELECT doc_id, path, licence, similarity, regexp_extract(path, '^(.*)/', 1) AS folder,
    regexp_matches(path, '/(LICENSE|NOTICE)$') AS is_file
  FROM noted LEFT JOIN own ON noted.statement = own.statement),
granted AS (
  SELECT folder AS directory, licence, similarity FROM seen WHERE is_file AND licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, licence) = 1),
near AS (
  SELECT f.folder, g.licence, g.similarity
  FROM (SELECT DISTINCT folder FROM seen) f JOIN granted g ON f.folder || '/' LIKE g.directory || '/%'
  QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(g.directory) DESC) = 1)
SELECT doc_id, path, coalesce(seen.licence, near.licence) AS licence,
  CASE WHEN seen.licence IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END
       WHEN near.licence IS NOT NULL THEN 'inherited' END AS found,
  coalesce(seen.similarity, near.similarity) AS similarity
FROM seen LEFT JOIN near ON seen.folder = near.folder
"""
