"""Folders that are ingested again, and versions that empty a document."""

import os

from docsearch_spark.session import scratch_path
from docsearch_spark.sources import snapshots
from docsearch_spark.streaming import ingest

BUILD = dict(dim=8, n_buckets=4)


def put(root, name, text, stamp):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (stamp, stamp))


def held(spark, path):
    if not any(n.startswith("bucket=") for n in os.listdir(path)):
        return {}
    rows = spark.read.parquet(path).select("source_path", "content").collect()
    return {r["source_path"].rsplit("/", 1)[-1]: r["content"] for r in rows}


def states(diff):
    return {r["path"].rsplit("/", 1)[-1]: r["state"] for r in diff.collect()}


def test_index_follows_a_folder(spark, tmpdir_path, monkeypatch):
    root, index, folder = (os.path.join(tmpdir_path, x) for x in ("files", "index", "snapshots"))
    for i in range(12):
        put(root, f"sub/{i}.txt", f"text {i}", 1000)
    put(root, "note.csv", "not a document", 1000)
    assert len(states(snapshots.ingest_changes(spark, root, index, folder, **BUILD))) == 12
    assert held(spark, index) == {f"{i}.txt": f"text {i}" for i in range(12)}

    def never(*_):
        raise AssertionError("an unchanged folder was opened")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "opened", never)
        assert states(snapshots.ingest_changes(spark, root, index, folder, **BUILD)) == {}
        assert len(os.listdir(folder)) == 1  # nothing new to note
        # removals alone open nothing either
        os.remove(os.path.join(root, "sub/3.txt"))
        assert states(snapshots.ingest_changes(spark, root, index, folder, **BUILD)) == {"3.txt": "removed"}
    assert "3.txt" not in held(spark, index) and len(held(spark, index)) == 11
    put(root, "sub/4.txt", "changed", 2000)
    put(root, "sub/5.txt", " ", 2000)
    put(root, "new.md", "added", 2000)
    read = []
    real = snapshots.opened
    monkeypatch.setattr(snapshots, "opened", lambda s, paths: read.extend(paths) or real(s, paths))
    diff = states(snapshots.ingest_changes(spark, root, index, folder, **BUILD))
    assert diff == {"4.txt": "changed", "5.txt": "changed", "new.md": "added"} and len(read) == 3
    got = held(spark, index)
    assert got["4.txt"] == "changed" and got["new.md"] == "added" and "5.txt" not in got and len(got) == 11
    for name in list(got):
        os.remove(os.path.join(root, name if name == "new.md" else f"sub/{name}"))
    snapshots.ingest_changes(spark, root, index, folder, **BUILD)
    assert held(spark, index) == {}
    put(root, "again.txt", "back", 3000)
    snapshots.ingest_changes(spark, root, index, folder, **BUILD)
    assert held(spark, index) == {"again.txt": "back"}


def test_listing_opens_no_file(spark, tmpdir_path):
    put(tmpdir_path, "a.txt", "x" * 1000, 1000)
    plan = snapshots.listing(spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_a_version_without_text_is_remembered(spark):
    root = scratch_path(spark, "versions")

    def land(*rows):
        df = spark.createDataFrame([(d, f"/{d}", t, v) for d, t, v in rows], ingest.LANDING_SCHEMA)
        return ingest.merge_batch(df, root, 1200, 200, 8, 4)

    def texts():
        return {r["doc_id"]: (r["content"], r["version"]) for r in ingest.current_index(spark, root).collect()}

    assert land((1, "one", 1), (2, "two", 1))
    assert land((1, "  ", 3)) == []          # blank: the old rows stay, the version is noted
    assert land((1, "late", 2)) == []        # older than the blank one
    assert texts() == {1: ("one", 1), 2: ("two", 1)}
    assert land((1, "  ", 3), (1, "late", 2)) == []  # a replay
    assert land((1, "four", 4), (2, None, 5))
    assert land((2, "late", 4)) == []
    assert texts() == {1: ("four", 4), 2: ("two", 1)}
