"""The newest version of each document, kept in streaming state.

``newest_versions`` lets a landed version pass only if it is newer than every version of
its document that the stream has seen. The state holds one number a document, by groups of
documents, in RocksDB and in the checkpoint, so nothing is looked up in the index. A version whose text is
blank passes as a tombstone and counts like any other: an older text that lands after it
stays out. The state is committed with the batch, so a batch that is run again passes the
same rows, and a restarted stream goes on with what it has seen.

Defined cases: rows without doc_id are not documents and do not pass; a missing version is
the oldest; of rows with the same document and version in one batch the one with the
greatest text passes, and none of a later batch; an empty batch passes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsearch_spark.functions.text import is_blank
from docsearch_spark.operators.index import DEFAULT_BUCKETS
from docsearch_spark.schemas import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from docsearch_spark.streaming.ingest import LANDING_SCHEMA, merge_batch

OLDEST = -(1 << 63)
#: Groups of documents, each one key of the state: a key costs several calls to the state
#: store a batch, whatever it holds, so a document of its own key would pay them alone.
GROUPS = 4096
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PASSED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source_path", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("version", T.LongType())])


class NewestVersion(StatefulProcessor):
    """Passes each document's greatest version of a batch if it is above the one held. A
    key is a group of documents: its state is read and written once a batch, as two arrays
    of longs (document ids, ascending, and their versions)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", T.StructType([T.StructField("ids", T.BinaryType()),
                                                               T.StructField("versions", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for part in rows:
            for doc, version, text, path in zip(part["doc_id"], part["version"], part["text"], part["source_path"]):
                rank = (int(version), text is not None, text or "", path or "")
                if doc not in best or rank > best[doc][0]:
                    best[int(doc)] = (rank, text, path)
        if not best:
            return
        stored = self.held.get() if self.held.exists() else None
        held = {} if stored is None else dict(zip(np.frombuffer(stored[0], np.int64).tolist(),
                                                  np.frombuffer(stored[1], np.int64).tolist()))
        passed = [(doc, b[2], b[1], b[0][0]) for doc, b in best.items() if doc not in held or held[doc] < b[0][0]]
        if not passed:
            return
        held.update((doc, version) for doc, _, _, version in passed)
        ids = np.array(sorted(held), np.int64)
        self.held.update((ids.tobytes(), np.array([held[i] for i in ids.tolist()], np.int64).tobytes()))
        doc, path, text, version = zip(*passed)
        yield pd.DataFrame({"doc_id": pd.Series(doc, dtype="int64"), "source_path": pd.Series(path, dtype=object),
                            "text": pd.Series(text, dtype=object), "version": pd.Series(version, dtype="int64")})

    def close(self) -> None:
        pass


def newest_versions(landed: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(doc_id, source_path, text, version, tombstone) of the versions that pass, from a
    stream of ``LANDING_SCHEMA``. Needs the RocksDB state store (``start`` sets it). The
    number of ``groups`` belongs to the checkpoint: a document must stay in its group."""
    versions = landed.filter(F.col("doc_id").isNotNull()).withColumn(
        "version", F.coalesce("version", F.lit(OLDEST)))
    passed = (versions.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
              .groupBy("grp").transformWithStateInPandas(
        NewestVersion(), outputStructType=PASSED, outputMode="Update", timeMode="None"))
    return passed.withColumn("tombstone", is_blank("text"))


def start(spark: SparkSession, versions: DataFrame, each_batch, checkpoint: str, available_now: bool = True):
    """Start a stream of :func:`newest_versions` with ``each_batch(rows, batch_id)``. The
    state store is set for this query only; the session's own setting is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        w = versions.writeStream.outputMode("update").foreachBatch(each_batch).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
        return w.start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def start_versioned_ingest(spark: SparkSession, landing_dir: str, index_root: str, checkpoint: str,
                           size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                           dim: int = 1536, n_buckets: int = DEFAULT_BUCKETS, available_now: bool = True,
                           files_a_batch: int = 1000):
    """D6 with the versions in the stream's state: what passes is merged into the index
    under ``index_root`` without a look at the versions it holds. A tombstone leaves the
    document's chunks, as a blank text does elsewhere. One checkpoint belongs to one
    index; with a lost checkpoint use ``ingest.start_incremental_ingest``, which reads the
    versions from the index's own table."""
    landed = (spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_a_batch)
              .parquet(landing_dir))

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.drop("tombstone"), index_root, size, overlap, dim, n_buckets, versions_known=True)

    return start(spark, newest_versions(landed), merge, checkpoint, available_now)
