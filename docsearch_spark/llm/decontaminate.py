"""Operator 10: benchmark decontamination by containment search.

Finds the test items that a document holds: at least 80 % of an item's distinct
five-word shingles anywhere in the document. Retrieval and verification are in
``containment``; everything runs in DataFrame functions.

Defined cases: a null or empty document holds nothing; a null or empty item is
never found; repeated rows of an item are one item, an item_id with two texts is
found for each; rows with one doc_id count as one
document, and so are rows without doc_id (found with a null doc_id); empty tables
give an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsearch_spark.llm.containment import find_contained
from docsearch_spark.llm.util import documents


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment, first_word, last_word)."""
    return find_contained(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir, "doc_id", "text"),
                        benchmark_items(spark, sf_dir)).drop("first_word", "last_word")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (
  SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
bs AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
q AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, any_value(q.n) AS n_shingles, count(*) AS n_found,
       count(*) / any_value(q.n) AS containment
FROM ds JOIN bs ON ds.s = bs.s JOIN q ON q.id = bs.id
GROUP BY ds.id, bs.id HAVING 100 * count(*) >= 80 * any_value(q.n)
"""
