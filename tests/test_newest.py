import os

from docsearch_spark.streaming import ingest, newest

SCHEMA = "doc_id long, source_path string, text string, version long"


def land(spark, folder, n, rows):
    """One file a landing, so that one landing is one batch."""
    from pathlib import Path
    part = os.path.join(folder, f"part{n}")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
    os.makedirs(os.path.join(folder, "landing"), exist_ok=True)
    (file,) = Path(part).glob("*.parquet")
    os.link(file, os.path.join(folder, "landing", f"{n:04d}.parquet"))


def passed(spark, folder):
    """Rows that pass in a run of the stream over what has landed since the last run."""
    out = []

    def keep(batch, batch_id):
        out.extend(tuple(r) for r in batch.collect())

    stream = spark.readStream.schema(ingest.LANDING_SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        os.path.join(folder, "landing"))
    newest.start(spark, newest.newest_versions(stream), keep, os.path.join(folder, "ck")).awaitTermination()
    return sorted(out)


def test_state_over_batches_and_restarts(spark, tmpdir_path):
    land(spark, tmpdir_path, 0, [(1, "/1", "one", 1), (2, "/2", "two", 5), (2, "/2", "older", 4), (None, "/", "x", 9)])
    land(spark, tmpdir_path, 1, [(1, "/1", " \n", 3), (3, None, "no version", None)])
    assert passed(spark, tmpdir_path) == [
        (1, "/1", " \n", 3, True), (1, "/1", "one", 1, False), (2, "/2", "two", 5, False),
        (3, None, "no version", newest.OLDEST, False)]
    assert passed(spark, tmpdir_path) == []  # nothing landed
    land(spark, tmpdir_path, 2, [(1, "/1", "late two", 2), (2, "/2", "same", 5), (3, "/3", "again", None),
                                 (2, "/2", "six a", 6), (2, "/2", "six b", 6), (4, "/4", None, 2**53 + 1)])
    assert passed(spark, tmpdir_path) == [(2, "/2", "six b", 6, False), (4, "/4", None, 2**53 + 1, True)]
    assert spark.conf.get(newest.STORE, "") != newest.ROCKSDB


def test_ingest_by_state(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "idx")

    def run():
        newest.start_versioned_ingest(spark, os.path.join(tmpdir_path, "landing"), root, os.path.join(tmpdir_path, "ck"),
                                      n_buckets=4, dim=8, files_a_batch=1).awaitTermination()
        return sorted((r["doc_id"], r["content"]) for r in ingest.current_index(spark, root).collect())

    land(spark, tmpdir_path, 0, [(i, f"/{i}", f"text {i}", 1) for i in range(12)])
    want = {i: f"text {i}" for i in range(12)}
    assert run() == sorted(want.items())
    land(spark, tmpdir_path, 1, [(3, "/3", " ", 3), (5, "/5", "five new", 2)])
    want[5] = "five new"
    assert run() == sorted(want.items())  # a blank text leaves the chunks
    land(spark, tmpdir_path, 2, [(3, "/3", "late", 2), (5, "/5", "late", 1), (20, "/20", "more", 1)])
    want[20] = "more"
    assert run() == sorted(want.items())


def test_a_batch_that_failed_is_run_again_with_the_same_rows(spark, tmpdir_path):
    land(spark, tmpdir_path, 0, [(1, "/1", "one", 1), (2, "/2", "two", 2)])
    tried = []

    def fail(batch, batch_id):
        tried.extend(tuple(r) for r in batch.collect())
        raise RuntimeError("lost")

    stream = spark.readStream.schema(ingest.LANDING_SCHEMA).parquet(os.path.join(tmpdir_path, "landing"))
    try:
        newest.start(spark, newest.newest_versions(stream), fail, os.path.join(tmpdir_path, "ck")).awaitTermination()
        raise AssertionError("the batch must fail")
    except AssertionError:
        raise
    except Exception as e:
        assert "lost" in str(e)
    assert passed(spark, tmpdir_path) == sorted(tried) and len(tried) == 2


def test_documents_of_one_group_have_their_own_versions(spark, tmpdir_path):
    def run():
        out = []
        stream = spark.readStream.schema(ingest.LANDING_SCHEMA).parquet(os.path.join(tmpdir_path, "landing"))
        newest.start(spark, newest.newest_versions(stream, groups=1),
                     lambda batch, _: out.extend((r["doc_id"], r["version"]) for r in batch.collect()),
                     os.path.join(tmpdir_path, "ck")).awaitTermination()
        return sorted(out)

    land(spark, tmpdir_path, 0, [(i, f"/{i}", f"text {i}", 2) for i in range(-3, 30)])
    assert run() == [(i, 2) for i in range(-3, 30)]
    land(spark, tmpdir_path, 1, [(i, f"/{i}", "later", 3 if i % 2 else 1) for i in range(-3, 31)])
    assert run() == sorted([(i, 3) for i in range(-3, 30) if i % 2] + [(30, 1)])
