"""Incremental ingest with Structured Streaming.

New document versions land as Parquet files (a new file name per version:
the file source does not re-deliver a file rewritten in place, trap T4).
Each micro-batch keeps the newest version per document, drops those that the
index already holds in the same or a newer version, chunks and embeds the rest,
and rewrites only the buckets they fall into:

* ``<root>/data/commit=<n>/bucket=<b>``: immutable bucket directories;
* ``<root>/manifest/<n>``: for every bucket the directory that is live since
  commit n, written last. A reader follows the highest complete manifest, so it
  never sees a half-written commit;
* ``<root>/versions``: (doc_id, version) of every version that was merged, also of one
  whose text has no chunks and so leaves no row in the index: an older version that
  lands later loses against it, too;
* a replayed batch (at-least-once ``foreachBatch``, trap T5) finds its versions
  there or in the index and commits nothing; commits are numbered by the manifests, so a
  stream that starts with a fresh checkpoint goes on where the index stands;
* directories that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.operators import index as I
from docsearch_spark.schemas import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from docsearch_spark.session import scratch_path
from docsearch_spark.sources.files import delete_path, list_names, path_exists

LANDING_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), True),
    T.StructField("source_path", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("version", T.LongType(), True),
])
MANIFEST = "bucket INT, path STRING"
VERSIONS = "doc_id BIGINT, version BIGINT, bucket INT"


def _commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    folder = f"{root.rstrip('/')}/manifest"
    return sorted(int(n) for n in list_names(spark, folder)
                  if n.isdigit() and "_SUCCESS" in list_names(spark, f"{folder}/{n}"))


def _live(spark: SparkSession, root: str, commit: int) -> dict[int, str]:
    """Bucket -> live directory, at most one entry a bucket."""
    rows = spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifest/{commit}").collect()
    return {r["bucket"]: r["path"] for r in rows}


def current_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The index as of the newest commit, or None before the first one."""
    commits = _commits(spark, root)
    paths = sorted(_live(spark, root, commits[-1]).values()) if commits else []
    return spark.read.parquet(*paths) if paths else None


@contextlib.contextmanager
def _scratch(spark: SparkSession) -> Iterator[tuple[Callable, Callable]]:
    """(store, drop): ``store`` writes a table and reads it back, as ``materialize`` does, ``drop``
    deletes one by its name; what is left goes at the end, also of a failed batch."""
    held: dict[str, str] = {}

    def store(df: DataFrame, name: str) -> DataFrame:
        held[name] = scratch_path(spark, name)
        df.write.parquet(held[name])
        return spark.read.schema(df.schema).parquet(held[name])

    def drop(name: str) -> None:
        if name in held:
            delete_path(spark, held.pop(name))

    try:
        yield store, drop
    finally:
        for name in list(held):
            drop(name)


def merge_batch(batch: DataFrame, root: str, size: int, overlap: int, dim: int, n_buckets: int,
                dense: bool = True, versions_known: bool = False) -> list[int]:
    """Merge (doc_id, source_path, text, version) rows; the buckets rewritten. With
    ``versions_known`` the caller has left out what is not newer than the index. What a
    batch stores on the way is deleted as soon as nothing reads it any more."""
    with _scratch(batch.sparkSession) as (store, drop):
        return _merge(batch, root, size, overlap, dim, n_buckets, dense, versions_known, store, drop)


def _merge(batch: DataFrame, root: str, size: int, overlap: int, dim: int, n_buckets: int, dense: bool,
           versions_known: bool, store: Callable, drop: Callable) -> list[int]:
    """:func:`merge_batch` with its scratch tables."""
    spark = batch.sparkSession
    root = root.rstrip("/")
    newest = store(I.newest_version(batch).withColumn("__bucket", I.doc_bucket("doc_id", n_buckets)),
                   "landed")
    commits = _commits(spark, root)
    live = _live(spark, root, commits[-1]) if commits else {}
    touched = [r[0] for r in newest.select("__bucket").distinct().collect()]  # at most n_buckets
    paths = [live[b] for b in touched if b in live]
    old = spark.read.parquet(*paths) if paths else None
    seen = [old.select("doc_id", "version")] if old is not None and not versions_known else []
    if not versions_known and path_exists(spark, f"{root}/versions"):
        seen.append(spark.read.schema(VERSIONS).parquet(f"{root}/versions")
                    .filter(F.col("bucket").isin(touched)).select("doc_id", "version"))
    if seen:
        held = functools.reduce(DataFrame.unionByName, seen).groupBy("doc_id").agg(F.max("version").alias("held"))
        newest = store(newest.join(held, "doc_id", "left").filter(
            F.col("held").isNull() | (F.col("version") > F.col("held"))).drop("held"), "newer")
        drop("landed")
    # sparse up to the write: dense vectors take part in no join and no shuffle
    chunks = store(I.build_index(newest, size, overlap, dim, n_buckets, dense=False, keep=("version",)), "chunks")
    newest = store(newest.select("doc_id", "version", "__bucket"), "merged")  # the texts are done with
    drop("landed")
    drop("newer")
    changed = sorted(r[0] for r in chunks.select("bucket").distinct().collect())
    if not changed:
        _note(newest, root)
        return []
    merged = chunks
    if old is not None:
        carried = (old.drop("embedding").withColumn("bucket", I.doc_bucket("doc_id", n_buckets))
                   .filter(F.col("bucket").isin(changed)))
        merged = I.replace_by_document(carried.select(*chunks.columns), chunks)
    number = commits[-1] + 1 if commits else 0
    data = f"{root}/data/commit={number}"
    I.write_index(I.late_dense(merged, dim) if dense else merged, data)
    live.update({b: f"{data}/bucket={b}" for b in changed})
    spark.createDataFrame(sorted(live.items()), MANIFEST).coalesce(1) \
        .write.mode("overwrite").json(f"{root}/manifest/{number}")
    _note(newest, root)  # after the commit: a replay in between finds the versions in the index
    _clean(spark, root)
    return changed


def _note(newest: DataFrame, root: str) -> None:
    """Append the versions that a batch has merged."""
    (newest.select("doc_id", "version", F.col("__bucket").alias("bucket"))
     .hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{root}/versions"))


def replace_documents(spark: SparkSession, root: str, documents: DataFrame, size: int = DEFAULT_CHUNK_SIZE,
                      overlap: int = DEFAULT_CHUNK_OVERLAP, dim: int = 1536,
                      n_buckets: int = I.DEFAULT_BUCKETS) -> list[int]:
    """D2 in batch with one commit: (doc_id, source_path, text) replace the index's rows
    of these documents under ``root``. Readers see the index before or after, never a
    mixture, and a job that fails before its manifest has changed nothing."""
    held = current_index(spark, root)
    newest = held.agg(F.max("version")).first()[0] if held is not None else None
    batch = documents.select("doc_id", "source_path", "text").withColumn(
        "version", F.lit((newest if newest is not None else -1) + 1).cast("long"))
    return merge_batch(batch, root, size, overlap, dim, n_buckets)


def _clean(spark: SparkSession, root: str) -> None:
    """Remove bucket directories that the last two manifests do not name."""
    commits = _commits(spark, root)
    named = {p for c in commits[-2:] for p in _live(spark, root, c).values()}
    for commit in list_names(spark, f"{root}/data"):
        for bucket in list_names(spark, f"{root}/data/{commit}"):
            path = f"{root}/data/{commit}/{bucket}"
            if bucket.startswith("bucket=") and path not in named \
                    and int(commit.split("=")[1]) <= commits[-1]:
                delete_path(spark, path)
    for c in commits[:-2]:
        delete_path(spark, f"{root}/manifest/{c}")


def start_incremental_ingest(spark: SparkSession, landing_dir: str, index_root: str, checkpoint: str,
                             size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                             dim: int = 1536, n_buckets: int = I.DEFAULT_BUCKETS,
                             available_now: bool = True):
    """Start the stream; with ``available_now`` it processes what has landed and stops."""
    stream = spark.readStream.schema(LANDING_SCHEMA).parquet(landing_dir)

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, index_root, size, overlap, dim, n_buckets)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
