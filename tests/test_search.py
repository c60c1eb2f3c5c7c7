"""Top-k retrieval against brute force (numpy), ties, zero and null vectors,
slicing of the broadcast side, and plan shapes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sf_paths import SF01
from docsearch_spark.operators import search


def brute(qs, ds, k, mode="cosine", exclude=False):
    out = {}
    for qid, q in qs:
        scored = []
        for did, d in ds:
            if exclude and qid == did:
                continue
            if d is None or q is None:
                s = None
            elif mode == "l2":
                s = float(np.sqrt(((np.array(q) - np.array(d)) ** 2).sum()))
            else:
                nq, nd = np.linalg.norm(q), np.linalg.norm(d)
                if mode == "cosine_eps":
                    s = float(np.dot(np.array(q) / (nq + 1e-12), np.array(d) / (nd + 1e-12)))
                else:
                    s = None if nq == 0 or nd == 0 else float(np.dot(q, d) / (nq * nd))
            scored.append((s, did))
        if mode == "l2":
            scored.sort(key=lambda x: (x[0] is None, round(x[0], 12) if x[0] is not None else 0, x[1]))
        else:
            scored.sort(key=lambda x: (x[0] is None, -round(x[0], 12) if x[0] is not None else 0, x[1]))
        out[qid] = [d for _, d in scored[:k]]
    return out


def run(spark, qs, ds, k, **kw):
    qdf = spark.createDataFrame(qs, "qid long, v array<double>")
    ddf = spark.createDataFrame(ds, "id long, v array<double>")
    h = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=k, **kw)
    got = {}
    for r in h.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    return got


def test_topk_with_ties_zero_and_null(spark):
    ds = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]),
          (5, None), (6, [2.0, 0.0, 0.0]), (7, [0.5, 0.5, 0.0])]
    qs = [(10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.1]), (12, [0.0, 0.0, 0.0])]
    for mode in ("cosine", "cosine_eps", "l2"):
        got = run(spark, qs, ds, 4, mode=mode)
        want = brute(qs, [(i, v) for i, v in ds], 4, mode)
        for q in (10, 11):
            assert got[q] == want[q], (mode, q)


def test_exclude_same_id_and_per_query_k(spark):
    rng = np.random.default_rng(3)
    ds = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    qs = ds[:6]
    got = run(spark, qs, ds, 5, exclude_same_id=True, mode="cosine_eps")
    want = brute(qs, ds, 5, "cosine_eps", exclude=True)
    assert got == want
    qdf = spark.createDataFrame([(i, v, i % 4) for i, v in qs], "qid long, v array<double>, k int")
    ddf = spark.createDataFrame(ds, "id long, v array<double>")
    h = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=50,
                         k_col=F.col("k"))
    counts = {r["query_id"]: r["n"] for r in h.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: i % 4 for i, _ in qs if i % 4 > 0}


def test_many_cells_give_same_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ds = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    qs = ds[:25]
    qdf = spark.createDataFrame(qs, "qid long, v array<double>")
    ddf = spark.createDataFrame(ds, "id long, v array<double>")
    a = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=3)
    b = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=3,
                         cell_bytes=700)  # several groups of either side
    monkeypatch.setattr(search, "MERGE_CELLS", 2)
    c = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=3, cell_bytes=700)
    assert sorted((r.query_id, r.doc_id, r.rank) for r in c.collect()) == sorted(
        (r.query_id, r.doc_id, r.rank) for r in a.collect())
    ra, rb = sorted(a.collect()), sorted(b.collect())
    assert [(r.query_id, r.doc_id, r.rank) for r in ra] == [(r.query_id, r.doc_id, r.rank) for r in rb]
    assert all(abs(x.value - y.value) < 1e-12 for x, y in zip(ra, rb))  # BLAS order differs by shape


def test_sparse_equals_dense(spark):
    rows = [(1, [0, 2], [0.6, 0.8]), (2, [1], [1.0]), (3, [], [])]
    df = spark.createDataFrame(rows, "id long, i array<int>, w array<double>")
    dense = df.select("id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.coalesce(
        F.try_element_at(F.map_from_arrays("i", "w"), j), F.lit(0.0))).alias("v"))
    q = spark.createDataFrame([(9, [0], [1.0])], "qid long, i array<int>, w array<double>")
    qd = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "qid long, v array<double>")
    a = search.topk_scan(df, "id", search.Sparse("i", "w", 3), q, "qid", search.Sparse("i", "w", 3), k=3)
    b = search.topk_scan(dense, "id", search.Dense("v", 3), qd, "qid", search.Dense("v", 3), k=3)
    assert [(r.doc_id, r.value) for r in a.orderBy("rank").collect()] == \
        [(r.doc_id, r.value) for r in b.orderBy("rank").collect()]


def test_rank_in_full_ranking(spark):
    rng = np.random.default_rng(11)
    ds = [(i, rng.normal(size=3).tolist()) for i in range(50)]
    ddf = spark.createDataFrame(ds, "id long, v array<double>")
    tq = [(100, ds[7][1], 7), (101, ds[3][1], 20)]
    rows = []
    for qid, qv, target in tq:
        q = np.array(qv) / (np.linalg.norm(qv) + 1e-12)
        sims = {i: round(float(np.dot(q, np.array(v) / (np.linalg.norm(v) + 1e-12))), 12) for i, v in ds}
        s = sims[target]
        rows.append((qid, qv, s, target, 1 + sum(1 for i, x in sims.items() if x > s or (x == s and i < target))))
    t = spark.createDataFrame([r[:4] for r in rows], "qid long, v array<double>, s double, t long")
    got = search.rank_in_full_ranking(ddf, "id", search.Dense("v", 3), t, "qid", search.Dense("v", 3), "s", "t").collect()
    assert {r["query_id"]: r["rank"] for r in got} == {r[0]: r[4] for r in rows}


def test_plans(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    one = search.topk_single(v, "embedding", [0.1] * 64, 5, id_col="vec_id")
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().executedPlan().toString()
    many = search.topk_scan(v, "vec_id", search.Dense("embedding", 64), v.limit(3), "vec_id",
                            search.Dense("embedding", 64), k=5)
    many.collect()
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CoGroupsInArrow" in plan and "CartesianProduct" not in plan \
        and "NestedLoopJoin" not in plan and "BroadcastExchange" not in plan


def test_ann_hits_are_true_cosines(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    a = search.ann_topk(v, "vec_id", v, "vec_id", "embedding", 64, k=5, n_tables=8, n_bits=3)
    e = search.topk_scan(v, "vec_id", search.Dense("embedding", 64), v, "vec_id", search.Dense("embedding", 64), k=5)
    j = a.join(e.select("query_id", "doc_id", "value"), ["query_id", "doc_id"])
    assert all(abs(r["score"] - r["value"]) < 1e-9 for r in j.collect())
    rec = search.ann_recall(e, a).agg(F.avg("recall")).first()[0]
    assert 0.0 < rec <= 1.0


def test_ann_finds_every_near_copy(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(size=64)
    ds = [(i, (center + 1e-4 * rng.normal(size=64)).tolist()) for i in range(60)]
    ds += [(100 + i, rng.normal(size=64).tolist()) for i in range(40)]
    v = spark.createDataFrame(ds, "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 5")
    exact = search.topk_scan(v, "vec_id", search.Dense("embedding", 64), q, "vec_id",
                             search.Dense("embedding", 64), k=5)
    approx = search.ann_topk(v, "vec_id", q, "vec_id", "embedding", 64, k=5, n_tables=8)
    assert sorted((r.query_id, r.doc_id, r.rank) for r in approx.collect()) == \
        sorted((r.query_id, r.doc_id, r.rank) for r in exact.collect())


def test_key_bits_grow_with_the_index():
    bits = [search.key_bits(n) for n in (0, 10, 1000, 10**6, 10**12)]
    assert bits == sorted(bits) and bits[0] == 1 and 10**12 / 2 ** bits[-1] <= search.BUCKET_ROWS


def test_one_row_of_another_width_leaves_the_others_alone(spark):
    ds = [(i, [1.0, float(i), 0.5]) for i in range(20)]
    bad = ds + [(99, [1.0, 2.0, 3.0, 4.0])]
    want, got = run(spark, ds[:3], ds, 5), run(spark, ds[:3], bad, 5)
    assert got == want


def test_unscorable_questions_and_mixed_id_types(spark):
    ds = [(f"{j:05d}", [1.0, float(j), 0.0]) for j in range(3000)]
    ddf = spark.createDataFrame(ds, "id string, v array<double>")
    qdf = spark.createDataFrame([(i, [0.0, 0.0, 0.0]) for i in range(50)], "qid long, v array<double>")
    h = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=2).collect()
    assert {(r.doc_id, r.value) for r in h} == {("00000", None), ("00001", None)} and len(h) == 100
    # identical ids are compared as text
    ints = spark.createDataFrame([(2, [1.0, 2.0, 0.0])], "qid long, v array<double>")
    text = spark.createDataFrame([("2", [1.0, 2.0, 0.0]), ("3", [1.0, 0.0, 0.0])], "id string, v array<double>")
    h = search.topk_scan(text, "id", search.Dense("v", 3), ints, "qid", search.Dense("v", 3), k=1,
                         exclude_same_id=True).collect()
    assert [r.doc_id for r in h] == ["3"]


def test_string_ids_and_exact_ties(spark):
    # duplicated vectors under string ids: ties must be cut by id ascending
    base = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]]
    ds = [(f"id{j:03d}", base[j % 3]) for j in range(60)]
    ddf = spark.createDataFrame(ds, "id string, v array<double>")
    qdf = spark.createDataFrame([("q1", [1.0, 0.1, 0.0]), ("q2", [0.0, 0.0, 1.0])], "qid string, v array<double>")
    h = search.topk_scan(ddf, "id", search.Dense("v", 3), qdf, "qid", search.Dense("v", 3), k=7)
    got = {}
    for r in h.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    want = brute([("q1", [1.0, 0.1, 0.0]), ("q2", [0.0, 0.0, 1.0])], ds, 7)
    assert got == want


def test_a_cell_makes_dense_only_a_tile_of_its_rows(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    index = pa.table({"id": list(range(40)), "v": list(x)})
    asked = pa.table({"query_id": list(range(40)), "q_v": list(x), "top_k": pa.array([3] * 40, pa.int32())})
    out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("value", pa.float64()), ("top_k", pa.int32())])

    def best(mode):
        spec = search.Dense("v", 6)
        return search._score_cell(index, asked, spec, spec, 6, mode, 3, False, False, out).to_pylist()

    made, real = [], search._matrix
    whole = {mode: best(mode) for mode in ("cosine", "l2")}
    monkeypatch.setattr(search, "TILE_BYTES", 7 * 8 * 6)
    monkeypatch.setattr(search, "_matrix", lambda rb, spec, dim, prefix="": (
        made.append(rb.num_rows) if not prefix else None) or real(rb, spec, dim, prefix))
    for mode, want in whole.items():
        got = best(mode)
        assert [(r["query_id"], r["doc_id"]) for r in got] == [(r["query_id"], r["doc_id"]) for r in want]
        assert np.allclose([r["value"] for r in got], [r["value"] for r in want], atol=1e-12)
    assert max(made) == 7
