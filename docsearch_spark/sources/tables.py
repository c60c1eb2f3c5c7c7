"""Readers for the parquet tables and adapters to the engine's contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.schemas import TOP_K_DEFAULT
from docsearch_spark.session import SPREAD

TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations",
          "pages")


# Tables whose rows carry heavy per-row work (long texts, vectors).
HEAVY = ("documents", "pages", "embeddings")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan.

    The scan's own splits are kept. Only where ``spark.docsearch.read.spread`` is set
    (one machine, tables of one small row group) heavy tables are spread.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = int(spark.conf.get(SPREAD, "0"))
    return df.repartition(spread) if spread > 1 and name in HEAVY else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the engine contract: doc_id, source_path, title, text.

    The ``source`` column stands in for both the file path and the title.
    """
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("source_path"),
                    F.col("source").alias("title"), "text")


def questions(spark: SparkSession, sf_dir: str, top_k=None) -> DataFrame:
    """``benchmark`` as a question table: query_id, question, top_k."""
    b = read_table(spark, sf_dir, "benchmark")
    k = F.lit(TOP_K_DEFAULT) if top_k is None else top_k
    return b.select(F.col("item_id").alias("query_id"),
                    F.col("text").alias("question"),
                    k.cast("int").alias("top_k"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (vec_id, embedding ARRAY<FLOAT>, label)."""
    return read_table(spark, sf_dir, "embeddings")
