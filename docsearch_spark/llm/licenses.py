"""Operator 5: license scan, MinHash bands over overlapping windows of the texts.

Templates are well-known notices. A text's words are its runs of letters and
digits, lower-cased, so punctuation and line breaks do not matter. Windows,
bands and the exact check are those of ``containment``: the windows overlap by
half, the number of bands follows from the wanted collision probability, and a
template counts as found when 80 % of its shingles are in the text.

Defined cases: a null or empty text has no license; a text may hold several
templates, one row each; rows with one doc_id are one document, and so are rows
without doc_id (found with a null doc_id); repeated rows of a template are one; an
empty table gives an empty table; other columns are ignored. The table of
templates is a parameter (name, text); these are the defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.containment import find_contained
from docsearch_spark.llm.util import documents

# Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "mit-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "bsd-redistribution": """Redistribution and use in source and binary forms, with or without modification,
        are permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(item_id, text) of the templates."""
    rows = sorted((TEMPLATES if texts is None else texts).items())
    return spark.createDataFrame(rows, "item_id string, text string")


def scan(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, license, n_shingles, n_found, containment, first_word, last_word)."""
    return find_contained(docs.select("doc_id", "text"), notices.select("item_id", "text"),
                          letter_words).withColumnRenamed("item_id", "license")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text"), templates(spark))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP5_SQL = r"""
WITH t AS (SELECT * FROM (VALUES __TEMPLATES__) AS v(id, text)),
dw AS (
  SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t),
dp AS (
  SELECT id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
bs AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw)),
q AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT dp.id AS doc_id, bs.id AS license, any_value(q.n) AS n_shingles,
       count(DISTINCT dp.s) AS n_found, count(DISTINCT dp.s) / any_value(q.n) AS containment,
       min(i) - 1 AS first_word, max(i) + 3 AS last_word
FROM dp JOIN bs ON dp.s = bs.s JOIN q ON q.id = bs.id
GROUP BY dp.id, bs.id HAVING 100 * count(DISTINCT dp.s) >= 80 * any_value(q.n)
""".replace("__TEMPLATES__", ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in sorted(TEMPLATES.items())))
