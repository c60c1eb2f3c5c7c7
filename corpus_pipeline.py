"""Training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

1. language ID: texts without letters go, and texts whose words are no language's: the
   mean probability of a word's best label is below ``MIN_CONFIDENCE``. A text in several
   languages whose words are told well stays, however its words are shared out.
2. exact dedup: of equal texts (white space aside) one stays.
3. near duplicates: of each group linked by Jaccard similarity the document with
   the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. byte-level BPE: token counts, digests of the ids and of what they decode to.

A document is told by its doc_id: a decision holds for every row with it, and a
row without doc_id is kept, but for stage 4, which tells such rows by their text.
Null texts have no letters and go in stage 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm import bpe, decontaminate, langid, quotient, vertical
from docsearch_spark.llm.util import materialize

#: The least mean probability of the words' labels.
MIN_CONFIDENCE = 0.5


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id); written first, so that it is
    computed once and its size is known to the planner."""
    ids = materialize(gone.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(ids, docs["doc_id"] == ids["gone_id"], "left_anti")


def confidence() -> Column:
    """The mean of the words' best probabilities, from the spans of equal labels."""
    words = F.aggregate("spans", F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]))
    return F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["p"] * (s["end"] - s["start"])) / words


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs)
    return without(docs, found.where((F.col("lang_pred") == langid.UNKNOWN) | (confidence() < MIN_CONFIDENCE)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quotient.exact_dedup(docs).where(~F.col("kept")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, vertical.similar_components(docs).where("component_id <> doc_id"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))
    found = decontaminate.contaminated(docs.select(name.alias("doc_id"), "text"),
                                       decontaminate.benchmark_items(spark, sf_dir))
    gone = materialize(found.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, name == F.col("gone_id"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontaminate", leaks),
    ("byte_bpe", tokens),
]

#: SQL cannot express language ID by a fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
