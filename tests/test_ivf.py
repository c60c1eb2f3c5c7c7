"""The trained approximate index: store, reopen, insert, search, tune."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sf_paths import SF01

from docsearch_spark.operators import ivf, search
from docsearch_spark.session import scratch_path

DIM = 10  # not a multiple of the subspace width


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(x)],
                                 "id bigint, embedding array<float>")


def clustered(n, clusters, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, DIM)) * 3
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, DIM)) * 0.3


def exact_top(x, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {i: set(np.argsort(-(unit @ (v / np.linalg.norm(v))), kind="stable")[:k].tolist())
            for i, v in enumerate(q)}


def recall(hits, want):
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    return np.mean([len(got.get(i, set()) & w) / len(w) for i, w in want.items()])


def test_stored_index_finds_clustered_neighbours_with_few_probes(spark):
    x = clustered(1500, 30)
    v = table(spark, x)
    built = ivf.build(v, "id", "embedding", DIM, scratch_path(spark, "ivf"))
    assert built.lists(spark).count() == 1500
    tuned = ivf.tune(built, v, "id", "embedding", k=5, target=0.95)
    opened = ivf.open_index(spark, built.path)
    assert (opened.probes, opened.depth) == (tuned.probes, tuned.depth)
    assert np.array_equal(opened.centroids, built.centroids) and np.array_equal(opened.codebooks, built.codebooks)
    assert opened.probes <= len(opened.centroids) // 4 and opened.depth <= 75  # 5 % of the rows
    hits = ivf.topk(opened, v, "id", "embedding", 5)
    assert recall(hits, exact_top(x, x, 5)) >= 0.95
    assert hits.groupBy("query_id").count().where("count <> 5").count() == 0


def test_whole_depth_and_probes_equal_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ivf, "GROUP_QUESTIONS", 11)
    monkeypatch.setattr(ivf, "TILE_ROWS", 5)
    monkeypatch.setattr(ivf, "TILE_QUESTIONS", 3)
    x = clustered(120, 4, seed=3)
    x[40:80] = x[40]  # a hot list of equal vectors
    v = table(spark, x)
    index = ivf.build(v, "id", "embedding", DIM, scratch_path(spark, "ivf"))
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in ivf.topk(index, v, "id", "embedding", 4).collect()}
    spec = search.Dense("embedding", DIM)
    want = {(r["query_id"], r["rank"]): r["doc_id"] for r in
            search.topk_scan(v, "id", spec, v, "id", spec, k=4).collect()}
    assert got == want


def test_inserts_are_found_and_counted_once(spark):
    x = clustered(400, 8, seed=5)
    path = scratch_path(spark, "ivf")
    index = ivf.build(table(spark, x[:300]), "id", "embedding", DIM, path)
    more = table(spark, x[300:], 300)
    for _ in range(2):
        ivf.insert(spark, index, more, "id", "embedding")
    held = ivf.open_index(spark, path).lists(spark)
    assert sorted(r["id"] for r in held.collect()) == list(range(400))
    hits = ivf.topk(index, more, "id", "embedding", 1)
    assert {r["query_id"]: r["doc_id"] for r in hits.collect()} == {i: i for i in range(300, 400)}


def test_vectors_without_a_direction_are_in_no_list(spark):
    x = clustered(60, 3, seed=7).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [
        (100, None), (101, [0.0] * DIM), (102, [1.0] * (DIM - 1)), (103, [float("nan")] * DIM), (104, [None] * DIM)]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    index = ivf.build(v, "id", "embedding", DIM, scratch_path(spark, "ivf"))
    assert index.lists(spark).agg(F.max("id")).first()[0] == 59
    hits = ivf.topk(index, v, "id", "embedding", 3)
    assert hits.select("query_id").distinct().count() == 60
    with pytest.raises(ValueError):
        ivf.build(v.where("id >= 100"), "id", "embedding", DIM, scratch_path(spark, "ivf"))


def test_recall_and_work_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    index = ivf.tune(ivf.build(v, "vec_id", "embedding", 64, scratch_path(spark, "ivf")), v, "vec_id", "embedding")
    spec = search.Dense("embedding", 64)
    exact = search.topk_scan(v, "vec_id", spec, v, "vec_id", spec, k=10)
    rec = search.ann_recall(exact, ivf.topk(index, v, "vec_id", "embedding", 10)).agg(F.avg("recall")).first()[0]
    assert rec >= 0.9 and index.depth <= 0.05 * v.count()
