"""Folders ingested again without reading them again.

A snapshot is a table of (path, length, modification time). Listing a folder needs no file
contents (``binaryFile`` reads them only where the column is used); an outer join with the
last snapshot tells which files are new, changed or gone, and only new and changed ones are
opened. The snapshot is written after the index, so an ingest that fails is made again
from the same differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.operators import index as IX
from docsearch_spark.schemas import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, EMBED_DIM
from docsearch_spark.session import materialize
from docsearch_spark.sources.files import delete_path, list_names, route_by_type, scan_documents

SNAPSHOT = "path STRING, length BIGINT, modified TIMESTAMP"
ADDED, CHANGED, REMOVED = "added", "changed", "removed"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of the supported files under ``root``; nothing is opened."""
    return scan_documents(spark, root).select("path", "length", F.col("modificationTime").alias("modified"))


def last_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete snapshot in ``folder``, empty before the first."""
    done = sorted((int(n) for n in list_names(spark, folder)
                   if n.isdigit() and "_SUCCESS" in list_names(spark, f"{folder}/{n}")))
    return (spark.read.schema(SNAPSHOT).parquet(f"{folder}/{done[-1]}") if done
            else spark.createDataFrame([], SNAPSHOT))


def differences(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, state) of the files that were added, changed or removed."""
    a, b = now.alias("a"), before.alias("b")
    state = (F.when(F.col("b.path").isNull(), ADDED).when(F.col("a.path").isNull(), REMOVED)
             .when((F.col("a.length") != F.col("b.length")) | (F.col("a.modified") != F.col("b.modified")), CHANGED))
    return (a.join(b, F.col("a.path") == F.col("b.path"), "full")
            .select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state")).where("state IS NOT NULL"))


def opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, source_path, text) of these files alone."""
    files = spark.read.format("binaryFile").load(paths)
    text, _, _ = route_by_type(files)
    return text.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_path"), "text")


def ingest_changes(spark: SparkSession, root: str, index_path: str, snapshots: str,
                   size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP, dim: int = EMBED_DIM,
                   n_buckets: int = IX.DEFAULT_BUCKETS) -> DataFrame:
    """D5 for a folder that is ingested again: the index follows its files.

    Chunks of removed files, and of changed files, leave the index; those of added and
    changed files enter it; buckets without a difference are not touched, and an unchanged
    folder writes nothing. Returns the differences (path, state). The driver holds the
    paths to open, as Spark's own file listing does.
    """
    now = materialize(listing(spark, root), "listing")
    diff = materialize(differences(now, last_snapshot(spark, snapshots)), "differences")
    fresh = [r["path"] for r in diff.where(F.col("state") != REMOVED).select("path").collect()]
    if not diff.limit(1).count():
        return diff
    gone = diff.where(F.col("state") != ADDED).select(F.xxhash64("path").alias("doc_id"))
    new = (IX.accepted(IX.build_index(opened(spark, fresh), size, overlap, dim, n_buckets), dim) if fresh else None)
    if any(n.startswith("bucket=") for n in list_names(spark, index_path)):
        ids = diff.select(F.xxhash64("path").alias("doc_id"))
        touched = [r[0] for r in ids.select(IX.doc_bucket("doc_id", n_buckets)).distinct().collect()]
        old = spark.read.parquet(index_path).where(F.col("bucket").isin(touched))
        kept = old.join(gone, "doc_id", "left_anti")
        merged = kept if new is None else IX.replace_by_document(kept, new.select(*old.columns))
        stage = materialize(merged.select(*old.columns), "stage")
        IX.write_index(stage, index_path)
        _clear(spark, index_path, touched, stage)
    elif new is not None:
        IX.write_index(new, index_path)
    number = 1 + max((int(n) for n in list_names(spark, snapshots) if n.isdigit()), default=-1)
    now.write.parquet(f"{snapshots}/{number}")
    return diff


def _clear(spark: SparkSession, index_path: str, touched: list[int], rows: DataFrame) -> None:
    """Remove the touched buckets that have no rows any more: an overwrite by partition
    leaves a partition alone that it gets no rows for."""
    left = {r[0] for r in rows.select("bucket").distinct().collect()}  # at most n_buckets
    for bucket in set(touched) - left:
        delete_path(spark, f"{index_path.rstrip('/')}/bucket={bucket}")
