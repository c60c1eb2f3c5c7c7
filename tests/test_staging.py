"""Staged files, and texts that a chunking normalises once."""

import os

import pytest
from pyspark.sql import functions as F

from docsearch_spark.operators import chunking
from docsearch_spark.plans import catalog
from docsearch_spark.session import scratch_path


def test_documents_are_staged_in_folders_and_scanned_whole(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(catalog, "FOLDER_FILES", 5)
    spark.createDataFrame([(i, f"text  {i}\n end") for i in range(-2, 28)], "doc_id long, text string") \
        .write.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    root = catalog._documents_as_files(spark, tmpdir_path).removeprefix("file://")
    assert 1 < len([n for n in os.listdir(root) if n.startswith("folder=")]) <= 6
    rows = catalog.QUERIES["scan_documents"](spark, tmpdir_path).collect()
    assert sorted((r["doc_id"], r["suffix"], r["text_norm"]) for r in rows) == [
        (i, ".txt", f"text {i} end") for i in range(-2, 28)]


def test_a_chunking_normalises_a_text_once(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit(" a \n b "), F.col("id").cast("string")).alias("text"))
    chunks = chunking.chunk_fixed(docs, "text", 4, 1)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [r["content"] for r in chunks.where("doc_id = 0").orderBy("chunk_index").collect()] == ["a b", "0"]


def test_staged_texts_are_files_of_their_folders(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(catalog, "FOLDER_FILES", 4)
    texts = [(i, f"té  {i}\n") for i in range(10)] + [(3, "other"), (11, None), (12, ""), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    root = catalog._documents_as_files(spark, tmpdir_path).removeprefix("file:")
    held = {}
    for folder, inner, names in os.walk(root):
        assert folder == root or not inner  # files lie in the folders, not in a directory each
        held.update((n, open(os.path.join(folder, n), encoding="utf-8").read()) for n in names if not n.startswith("."))
    want = {f"doc_id={i}.txt": t + "\n" for i, t in texts[:10]}
    want["doc_id=3.txt"] = "other\n" + want["doc_id=3.txt"]
    assert held == want | {"doc_id=11.txt": "\n", "doc_id=12.txt": "\n", f"doc_id={catalog.NO_ID}.txt": "no id\n"}


def test_dense_rows_are_not_sorted_by_bucket_before_the_write(spark, monkeypatch):
    """Tasks keep some buckets' files open; the session's setting is as before, also after a failure."""
    from pyspark.sql.readwriter import DataFrameWriter

    from docsearch_spark.operators import index as IX
    docs = spark.createDataFrame([(i, f"/{i}", f"text {i} " * 300) for i in range(200)],
                                 "doc_id long, source_path string, text string").coalesce(1)
    seen, before, path = [], spark.conf.get(IX.WRITERS), scratch_path(spark, "index")
    real = DataFrameWriter.parquet

    def spy(writer, *args, **kw):
        seen.append(int(spark.conf.get(IX.WRITERS)))
        return real(writer, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    IX.write_index(IX.late_dense(IX.build_index(docs, dim=32, n_buckets=16, dense=False), 32), path)
    assert seen and min(seen) >= IX.OPEN_BUCKETS and spark.conf.get(IX.WRITERS) == before
    got = spark.read.parquet(path)
    want = IX.build_index(docs, dim=32, n_buckets=16)
    cols = ["doc_id", "chunk_index", "bucket", "content", "embedding"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    wrong = IX.late_dense(IX.build_index(docs, dim=32, n_buckets=16, dense=False), 32).withColumn(
        "chunk_id", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        IX.write_index(wrong, scratch_path(spark, "index"))
    assert spark.conf.get(IX.WRITERS) == before


def test_a_merged_batch_leaves_no_scratch_tables(spark, monkeypatch):
    """Not after a commit, a batch without news, or a failed write; the index is as before."""
    from docsearch_spark.operators import index as IX
    from docsearch_spark.session import checkpoint_dir
    from docsearch_spark.streaming import ingest

    def held():
        return {n for n in os.listdir(checkpoint_dir(spark).removeprefix("file://"))
                if n.split("-")[0] in ("landed", "newer", "chunks", "merged")}

    def batch(version, ids):
        return spark.createDataFrame([(i, f"/{i}", f"text {i} in {version}", version) for i in ids], ingest.LANDING_SCHEMA)

    root, before = scratch_path(spark, "stream"), held()
    assert ingest.merge_batch(batch(1, range(9)), root, 200, 20, 16, 4)
    assert ingest.merge_batch(batch(2, (1, 5)), root, 200, 20, 16, 4)
    assert ingest.merge_batch(batch(1, (1, 5)), root, 200, 20, 16, 4) == []
    real = IX.write_index
    monkeypatch.setattr(IX, "write_index", lambda *a, **k: real(*a, **k) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.merge_batch(batch(3, (2,)), root, 200, 20, 16, 4)
    assert held() == before
    rows = ingest.current_index(spark, root).select("doc_id", "content").collect()
    assert sorted((r[0], r[1]) for r in rows) == [(i, f"text {i} in {2 if i in (1, 5) else 1}") for i in range(9)]
