"""Containment search with MinHash bands over windows, in DataFrame functions only.

Short passages (items) are looked for inside texts of any length. Whole texts
cannot be sketched for that: the Jaccard similarity of a short item and a long
text is next to nothing. So:

1. Items are partitioned by size: an item of q distinct shingles is in class u,
   the power of two with u / 2 < q <= u. For each class a text is a row of windows
   of 2 u shingles, one every u, so a passage of u shingles lies in one window.
   If 80 % of an item's shingles are there, the Jaccard similarity to that window
   is at least 0.8 (u / 2) / (2 u + 0.1 u), whatever the text's length.
2. MinHash with one row a band: ``bands`` least hashes under different seeds.
   ``bands_for`` takes as many as that the chance to share none stays under
   ``MISS`` at that similarity.
3. A window can only share a least hash with an item if it holds a shingle of an
   item. So the texts' shingles first meet the distinct shingles of all items, which
   tell nothing but the classes they occur in; windows without one are never hashed.
4. The other windows are hashed and meet the items' bands. Only this names the
   (document, item) pairs: the candidates.
5. Candidates are verified exactly, over the whole text: an item's shingles, brought
   along by the candidate, meet the document's (one row a document and shingle);
   distinct shingles found / distinct shingles of the item.

Rows with one doc_id are one document, rows without doc_id another one. Repeated rows
of an item are one; an item_id with several texts is several items.
An item of fewer words than a shingle is one shingle, its whole sequence, and
only a text that is that sequence holds it. Items without words are never found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch_spark.functions.text import let
from docsearch_spark.llm.util import SHINGLE_WORDS, SIMILARITY_PERCENT, materialize

#: Chance that a window with a whole item shares no band with it.
MISS = 1e-6
BLANKS = " \t\n\x0b\f\r"


def plain_words(text: Column) -> Column:
    """Lower-cased words between white space."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingles(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """64-bit names of the runs of ``size`` words, in order."""
    return let(words, lambda w: F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
    ).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))


def bands_for(percent: int = SIMILARITY_PERCENT, miss: float = MISS) -> int:
    """Bands of one row, for the least similarity of a window that holds an item."""
    c = percent / 100
    least = c * 0.5 / (2 + (1 - c) * 0.5)
    return math.ceil(math.log(miss) / math.log(1 - least))


def least_hashes(grouped, bands: int) -> DataFrame:
    """Adds ``sketch``: an array of the least hash under each seed."""
    return grouped.agg(*[F.min(F.xxhash64("shingle", F.lit(i))).alias(f"m{i}") for i in range(bands)])


def banded(df: DataFrame, bands: int, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.array(*[f"m{i}" for i in range(bands)])).alias("band", "least"))


def find_contained(docs: DataFrame, items: DataFrame, words=plain_words,
                   percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment, first_word, last_word).

    ``docs`` has doc_id and text, ``items`` item_id and text. first_word and
    last_word bound the item's shingles in the text, by word number.
    """
    bands = bands_for(percent)
    sets = items.select("item_id", F.sort_array(F.array_distinct(shingles(words(F.col("text"))))).alias("sh"))
    # an item is told by its id and its set, so repeated rows of it are one
    sets = (sets.where(F.size("sh") > 0).withColumn("q", F.size("sh"))
            .withColumn("name", F.xxhash64("sh")).dropDuplicates(["item_id", "name"]))
    pieces = materialize(sets.select(
        "item_id", "name", "q", F.pow(F.lit(2.0), F.ceil(F.log2("q"))).cast("int").alias("u"),
        F.explode("sh").alias("shingle")), "items")
    sketch = banded(least_hashes(pieces.groupBy("item_id", "name", "u"), bands), bands,
                    "item_id", "name", "u")
    # written, so that its size is known where all shingles of the texts meet it
    classes = materialize(pieces.groupBy("shingle").agg(F.collect_set("u").alias("classes")), "classes")

    numbered = docs.select("doc_id", F.posexplode(shingles(words(F.col("text")))).alias("pos", "shingle"))
    hits = materialize(numbered.join(classes, "shingle").select("doc_id", "pos", "shingle", "classes"), "hits")
    at = F.floor(F.col("pos") / F.col("u")).cast("int")
    windows = (hits.select("doc_id", "pos", F.explode("classes").alias("u"))
               .select("doc_id", "u", F.explode(F.array(at, at - 1)).alias("w")).where("w >= 0")
               .distinct())
    wanted = materialize(windows.groupBy(F.col("doc_id").alias("wanted_id")).agg(
        F.collect_list(F.struct("u", "w")).alias("windows")), "wanted")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select(
        "doc_id", shingles(words(F.col("text"))).alias("sh"), "windows")
    parts = texts.select("doc_id", "sh", F.explode("windows").alias("x")).select(
        "doc_id", "x.u", "x.w",
        F.explode(F.slice("sh", F.col("x.w") * F.col("x.u") + 1, F.col("x.u") * 2)).alias("shingle"))
    found = banded(least_hashes(parts.groupBy("doc_id", "u", "w"), bands), bands, "doc_id", "u")
    candidates = (found.select("doc_id", "u", "band", "least").distinct()
                  .join(sketch, ["u", "band", "least"])
                  .select("doc_id", "item_id", "name").distinct())
    due = candidates.join(pieces, (candidates["name"] == pieces["name"])
                          & candidates["item_id"].eqNullSafe(pieces["item_id"])).select(
        candidates["doc_id"].alias("due_id"), candidates["item_id"], candidates["name"], "q",
        F.col("shingle").alias("due"))
    held = hits.groupBy("doc_id", "shingle").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return (due.join(held, (F.col("due") == F.col("shingle")) & F.col("due_id").eqNullSafe(F.col("doc_id")))
            .groupBy("doc_id", "item_id", "name", "q")
            .agg(F.count("*").alias("n_found"), F.min("first").cast("bigint").alias("first_word"),
                 (F.max("last") + SHINGLE_WORDS - 1).cast("bigint").alias("last_word"))
            .where(F.col("n_found") * 100 >= F.col("q") * percent)
            .select("doc_id", "item_id", F.col("q").cast("bigint").alias("n_shingles"), "n_found",
                    (F.col("n_found") / F.col("q")).alias("containment"), "first_word", "last_word"))
