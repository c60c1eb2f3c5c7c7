"""Chunk index maintenance.

The index is a Parquet table partitioned by ``bucket = pmod(xxhash64(doc_id), B)``.
Replacing a document touches one bucket; a re-ingest batch rewrites only the
buckets it touches (dynamic partition overwrite), and the untouched documents
of those buckets are carried over by an anti join (trap T10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch_spark.functions.text import uuid_from
from docsearch_spark.operators import chunking, embed, store
from docsearch_spark.session import scratch_path
from docsearch_spark.sources.files import path_exists, read_documents
from docsearch_spark.schemas import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, EMBED_DIM, INDEX

DEFAULT_BUCKETS = 64
# Fixed value: the ingest message format of the re-built application.
INGEST_MESSAGE = "Ingested %d file(s), %d chunk(s)."


def doc_bucket(doc_id, n_buckets: int = DEFAULT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id) if isinstance(doc_id, str) else doc_id),
                  F.lit(n_buckets)).cast("int")


def assign_ids(chunks: DataFrame) -> DataFrame:
    """Deterministic chunk ids (md5 of doc_id and chunk_index) and one
    creation time per job."""
    return (chunks.withColumn("chunk_id", uuid_from("doc_id", "chunk_index"))
            .withColumn("created_at", F.current_timestamp()))


def chunk_documents(documents: DataFrame, size: int = DEFAULT_CHUNK_SIZE,
                    overlap: int = DEFAULT_CHUNK_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """B1-B3 + D1 over (doc_id, source_path, text); chunks keep their document's ``keep`` columns."""
    ch = chunking.chunk_fixed(documents.select("doc_id", "source_path", "text", *keep), "text", size, overlap)
    return assign_ids(ch).select("chunk_id", "doc_id", "source_path", "chunk_index", "content", "created_at", *keep)


def build_index(documents: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                dim: int = EMBED_DIM, n_buckets: int = DEFAULT_BUCKETS, dense: bool = True,
                provider_factory=None, vectors: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """D5 as a DataFrame: chunk, embed, bucket.

    With the default embedder this is narrow: parallelism follows the input's splits.
    A ``provider_factory`` embeds with another model, through the content store at
    ``vectors`` if there is one, so that only contents it has not seen are sent. Rows are
    dealt to buckets where they are written (:func:`write_index`); with ``dense`` off they
    move there in sparse form.
    """
    ch = chunk_documents(documents, size, overlap, keep).withColumn("bucket", doc_bucket("doc_id", n_buckets))
    if provider_factory is not None:
        return (store.embed_through_store(ch, "content", provider_factory, vectors) if vectors
                else embed.embed_with_provider(ch, "content", provider_factory))
    out = embed.embed_sparse(ch, "content", dim)
    if dense:
        out = embed.densify_batches(out, "sv_idx", "sv_val", dim, "embedding")
    return out


def replace_by_document(old: DataFrame, new: DataFrame, new_documents: DataFrame | None = None,
                        purge_empty: bool = False) -> DataFrame:
    """Every old row of a re-ingested document is replaced by its new rows;
    other documents stay.

    A document whose new text yields no chunks keeps its old rows (the
    reference skips it before deleting); with ``purge_empty`` and the list of
    re-ingested documents, such documents are removed instead.
    """
    touched = new.select("doc_id").distinct()
    if purge_empty and new_documents is not None:
        touched = touched.unionByName(new_documents.select("doc_id")).distinct()
    kept = old.join(touched, "doc_id", "left_anti")
    return kept.unionByName(new.select(*old.columns))


def newest_version(batch: DataFrame, version_col: str = "version") -> DataFrame:
    """Keep the highest version of each document in a landing batch (replay-safe).

    One aggregation by doc_id (``max_by`` of the whole row, combined map-side)."""
    cols = [c for c in batch.columns if c != "doc_id"]
    best = batch.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.col(version_col)).alias("__r"))
    return best.select("doc_id", *[F.col(f"__r.{c}").alias(c) for c in cols])


def check_constraints(chunks: DataFrame) -> DataFrame:
    """D3: NOT NULL violations per column and duplicated chunk ids, in one row.

    One aggregation by chunk_id (partial aggregation keeps the shuffle to
    distinct ids) and one global aggregate over its output; no joins."""
    cols = ["chunk_id", "doc_id", "source_path", "chunk_index", "content", "embedding"]
    present = [c for c in cols if c in chunks.columns]
    per_id = chunks.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in present])
    dup = F.col("chunk_id").isNotNull() & (F.col("__n") > 1)
    return per_id.agg(*[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in present],
                      F.sum(dup.cast("long")).alias("dup_ids"),
                      F.coalesce(F.sum(F.when(dup, F.col("__n"))), F.lit(0)).alias("dup_rows"))


def ingest_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(files_processed, chunks_written, message); documents without chunks
    still count as processed."""
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = documents.select("doc_id").join(per_doc, "doc_id", "left")
    s = j.agg(F.count(F.lit(1)).alias("files_processed"),
              F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_written"))
    return s.select("files_processed", "chunks_written",
                    F.format_string(INGEST_MESSAGE, "files_processed", "chunks_written").alias("message"))


#: Metadata of ``sv_idx``: the width of the embedding that the write adds.
LATE = "embedding_dim"


def late_dense(index: DataFrame, dim: int) -> DataFrame:
    """``index`` in sparse form, to get its ``embedding`` of width ``dim`` where it is written."""
    return index.withColumn("sv_idx", F.col("sv_idx").alias("sv_idx", metadata={LATE: dim}))


#: Spark's setting of the files that a task may keep open, and buckets that a task writes at once.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_BUCKETS = 4


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Typed write (the columns of the index contract are cast to its types),
    partitioned by bucket; with dynamic partition overwrite only the buckets
    present in ``index`` are replaced.

    Rows are rebalanced by bucket: the planner splits large buckets over several
    tasks and merges small ones, by their actual sizes. Rows of :func:`late_dense` get
    their ``embedding`` behind that shuffle. A task keeps the files of ``OPEN_BUCKETS`` buckets
    open at once; rows of further ones are sorted by bucket, which else all dense rows would be."""
    # ids keep the caller's type; nothing casts between nullable and other elements
    kinds = {f.name: f.dataType for f in INDEX.fields if f.name not in ("doc_id", "embedding")}
    typed = index.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in index.columns])
    dealt = typed.hint("rebalance", "bucket")
    dim = index.schema["sv_idx"].metadata.get(LATE) if "sv_idx" in index.columns else None
    if dim is not None:
        dealt = dealt.withColumn("sv_idx", F.col("sv_idx").alias("sv_idx", metadata={}))
        dealt = accepted(embed.densify_batches(dealt, "sv_idx", "sv_val", dim, "embedding"), dim)
    spark = index.sparkSession
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(max(OPEN_BUCKETS, int(before))))
    try:
        (dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
    finally:
        spark.conf.set(WRITERS, before)


def reingest(spark, index_path: str, new_documents: DataFrame, staging_path: str,
             size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
             dim: int = EMBED_DIM, n_buckets: int = DEFAULT_BUCKETS,
             provider_factory=None, vectors: str | None = None) -> None:
    """D2 on storage: read only the touched buckets (partition pruning), replace
    the documents, stage the result, then overwrite just those buckets. New vectors are
    checked first (C5): a wrong one fails the job before anything is written.

    Staging first means the path being read is never overwritten while read. Readers of
    the path can see some buckets before and some after; where that matters, use
    ``streaming.ingest.replace_documents``, which commits through a manifest.
    """
    held = spark.read.parquet(index_path)
    sparse = provider_factory is None and {"sv_idx", "sv_val"} <= set(held.columns)
    new_idx = build_index(new_documents, size, overlap, dim, n_buckets, dense=not sparse,
                          provider_factory=provider_factory, vectors=vectors)
    if not sparse:
        new_idx = accepted(new_idx, dim)
    touched = [r["bucket"] for r in new_documents.select(doc_bucket("doc_id", n_buckets).alias("bucket"))
               .distinct().collect()]  # at most n_buckets small ints
    old = held.filter(F.col("bucket").isin(touched))
    if sparse:  # the dense form is made again behind the last shuffle
        old = old.drop("embedding")
    merged = replace_by_document(old, new_idx.select(*old.columns))
    merged.write.mode("overwrite").parquet(staging_path)
    staged = spark.read.parquet(staging_path)
    write_index(late_dense(staged, dim) if sparse and "embedding" in held.columns else staged, index_path)


def ingest_files(spark, root: str, index_path: str, size: int = DEFAULT_CHUNK_SIZE,
                 overlap: int = DEFAULT_CHUNK_OVERLAP, dim: int = EMBED_DIM,
                 n_buckets: int = DEFAULT_BUCKETS, provider_factory=None, vectors: str | None = None) -> None:
    """D5 from files: scan, decode and route (A1, A2, A4), chunk and embed (B1-B3, C1,
    D1), check the vectors (C5), and write; files that the index already holds are
    replaced by document (D2). ``vectors`` is the content store of ``provider_factory``."""
    documents = read_documents(spark, root)
    if path_exists(spark, index_path):
        reingest(spark, index_path, documents, scratch_path(spark, "stage"), size, overlap, dim, n_buckets,
                 provider_factory, vectors)
        return
    if provider_factory is None:
        write_index(late_dense(build_index(documents, size, overlap, dim, n_buckets, dense=False), dim), index_path)
        return
    write_index(accepted(build_index(documents, size, overlap, dim, n_buckets, provider_factory=provider_factory,
                                     vectors=vectors), dim), index_path)


def accepted(index: DataFrame, dim: int) -> DataFrame:
    """The index; a vector that C5 rejects fails the job with its reason."""
    v = F.col("embedding")
    wrong = v.isNull() | (F.size(v) != dim)
    if index.schema["embedding"].dataType.containsNull:
        wrong = wrong | F.exists(v, lambda x: x.isNull())
    return index.withColumn("embedding", F.when(wrong, F.raise_error(
        F.format_string("chunk %s: not a vector of %d dimensions", "chunk_id", F.lit(dim))
    ).cast("array<float>")).otherwise(v))
