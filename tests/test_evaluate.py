"""Evaluation metrics: golden values, identities, empty report, global rank."""

import pytest
from pyspark.sql import functions as F

from sf_paths import SF01
from docsearch_spark.operators import evaluate as E
from docsearch_spark.operators import search

# FIXTURES golden values: queries vec_id < 20, relevant = same label, other id
GOLDEN = {("ndcg", 1): 0.05, ("ndcg", 3): 0.06480, ("ndcg", 5): 0.10885, ("ndcg", 10): 0.11763,
          ("map", 1): 0.00098, ("map", 3): 0.00251, ("map", 5): 0.00515, ("map", 10): 0.00827,
          ("recall", 1): 0.00098, ("recall", 3): 0.00375, ("recall", 5): 0.01316, ("recall", 10): 0.02689,
          ("precision", 1): 0.05, ("precision", 3): 0.06667, ("precision", 5): 0.13, ("precision", 10): 0.13}


@pytest.fixture(scope="module")
def golden_rows(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    a, b = v.alias("a"), v.alias("b")
    qrels = (a.filter(F.col("a.vec_id") < 20)
             .join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id")))
             .select(F.col("a.vec_id").alias("query_id"), F.col("b.vec_id").alias("doc_id"),
                     F.lit(1).alias("grade")))
    spec = search.Dense("embedding", 64)
    rows, nq, cs = E.metric_rows(v, "vec_id", spec, v, "vec_id", spec, qrels)
    return {(r["metric"], r["k"]): r["value"] for r in rows.collect()}, nq.first()[0], cs.first()[0]


def test_golden_metrics(golden_rows):
    vals, nq, cs = golden_rows
    for key, want in GOLDEN.items():
        assert vals[key] == pytest.approx(want, abs=1e-5), key
    assert nq == 20 and cs == 500


def test_mrr_keeps_identical_ids(golden_rows):
    vals, _, _ = golden_rows
    assert vals[("mrr", None)] == pytest.approx(0.17133, abs=1e-5)
    assert vals[("mrr", None)] != pytest.approx(0.23423, abs=1e-3)


def test_identities(golden_rows):
    vals, _, _ = golden_rows
    assert vals[("map", 1)] == vals[("recall", 1)]
    assert vals[("precision", 1)] >= vals[("recall", 1)]
    assert all(vals[("ndcg", k)] <= 1.0 for k in (1, 3, 5, 10))


def test_empty_report(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    qrels = spark.createDataFrame([(1, 2, 0), (3, 4, -1)], "query_id long, doc_id long, grade int")
    spec = search.Dense("embedding", 64)
    rows, nq, cs = E.metric_rows(v, "vec_id", spec, v, "vec_id", spec, qrels)
    report = E.metric_report(rows, nq, cs, "x", "n")
    rep = report.first()
    assert rep["num_queries"] == 0 and rep["mrr"] == 0.0 and rep["notes"] == E.EMPTY_NOTE
    assert rep["recall_at_k"] == {"Recall@1": 0.0, "Recall@3": 0.0, "Recall@5": 0.0, "Recall@10": 0.0}
    # entry order inside the JVM map (Python dicts from collect() do not keep it)
    keys = report.select(F.map_keys("ndcg_at_k")).first()[0]
    assert keys == ["NDCG@1", "NDCG@3", "NDCG@5", "NDCG@10"]


def test_graded_ndcg_by_hand(spark):
    # one query, docs 1..4; vectors chosen so the ranking is 1, 2, 3, 4
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.5, 0.5]), (4, [0.0, 1.0])],
                                "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, v array<double>")
    qrels = spark.createDataFrame([(9, 2, 3), (9, 4, 1), (9, 3, 0)], "query_id long, doc_id long, grade int")
    rows, _, _ = E.metric_rows(idx, "id", search.Dense("v", 2), q, "qid", search.Dense("v", 2), qrels, k_values=(3,))
    vals = {(r["metric"], r["k"]): r["value"] for r in rows.collect()}
    import math
    dcg = 3 / math.log2(3)
    idcg = 3 / math.log2(2) + 1 / math.log2(3)
    assert vals[("ndcg", 3)] == round(dcg / idcg, 5)
    assert vals[("recall", 3)] == 0.5 and vals[("precision", 3)] == round(1 / 3, 5)
    assert vals[("map", 3)] == round((1 / 2) / 2, 5)
    assert vals[("mrr", None)] == 0.5


def test_global_rank_and_caps(spark):
    df = spark.createDataFrame([(i,) for i in [10, 2, 33, 1, 100, 5]], "id long").repartition(3)
    got = sorted(r["id"] for r in E.cap_by_id(df, "id", 3).collect())
    assert got == sorted(sorted([10, 2, 33, 1, 100, 5], key=str)[:3])
    assert E.cap_by_id(df, "id", 0).count() == 6


def test_check_dataset():
    assert E.check_dataset(" SciFact ") == "scifact"
    with pytest.raises(ValueError):
        E.check_dataset("msmarco")


def test_cap_is_exact_under_aqe_coalescing(spark):
    # regression: the per-partition offsets must come from the same partitions as the rows
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    want = sorted(sorted(r[0] for r in v.select("vec_id").collect())[:0] or
                  sorted((r[0] for r in v.select("vec_id").collect()), key=str)[:250])
    capped = E.cap_by_id(v, "vec_id", 250).persist()
    assert sorted(r[0] for r in capped.select("vec_id").collect()) == want
    assert sorted(r[0] for r in capped.select("vec_id", "embedding").collect()) == want


def _brute_metrics(docs, queries, qrels, ks):
    """Plain-Python metrics: @k with the query's own id removed, MRR with it kept."""
    import math

    import numpy as np
    rel = {}
    for q, d, g in qrels:
        if g > 0 and d in docs:
            rel.setdefault(q, {})[d] = g
    out = {}
    per = {k: {"ndcg": [], "map": [], "recall": [], "precision": []} for k in ks}
    rrs = []
    for q in sorted(rel):
        qv = np.array(queries[q]) / (np.linalg.norm(queries[q]) + 1e-12)
        sims = {d: round(float(np.dot(qv, np.array(v) / (np.linalg.norm(v) + 1e-12))), 12) for d, v in docs.items()}
        full = sorted(sims, key=lambda d: (-sims[d], d))
        rr = 0.0
        for i, d in enumerate(full, 1):
            if d in rel[q]:
                rr = 1.0 / i
                break
        rrs.append(rr)
        ranked = [d for d in full if d != q]
        grades = sorted(rel[q].values(), reverse=True)
        for k in ks:
            top = ranked[:k]
            hits = [1 if d in rel[q] else 0 for d in top]
            dcg = sum(rel[q].get(d, 0) / math.log2(i + 2) for i, d in enumerate(top))
            idcg = sum(g / math.log2(i + 2) for i, g in enumerate(grades[:k]))
            ap = sum(sum(hits[:i + 1]) / (i + 1) for i in range(len(top)) if hits[i]) / len(rel[q])
            per[k]["ndcg"].append(dcg / idcg if idcg else 0.0)
            per[k]["map"].append(ap)
            per[k]["recall"].append(sum(hits) / len(rel[q]))
            per[k]["precision"].append(sum(hits) / k)
    for k in ks:
        for m, vals in per[k].items():
            out[(m, k)] = round(sum(vals) / len(vals), 5) if vals else 0.0
    out[("mrr", None)] = sum(rrs) / len(rrs) if rrs else 0.0
    return out


def test_metrics_against_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    docs = {i: rng.normal(size=4).tolist() for i in range(40)}
    queries = {i: rng.normal(size=4).tolist() for i in range(0, 12, 2)}  # ids overlap doc ids
    qrels = [(q, int(d), int(g)) for q in queries for d, g in
             zip(rng.choice(40, 6, replace=False), rng.integers(-1, 4, 6))]
    idx = spark.createDataFrame(list(docs.items()), "id long, v array<double>")
    qs = spark.createDataFrame(list(queries.items()), "qid long, v array<double>")
    qr = spark.createDataFrame(qrels, "query_id long, doc_id long, grade int")
    ks = (1, 2, 5, 10)
    rows, _, _ = E.metric_rows(idx, "id", search.Dense("v", 4), qs, "qid", search.Dense("v", 4), qr, k_values=ks)
    got = {(r["metric"], r["k"]): r["value"] for r in rows.collect()}
    want = _brute_metrics(docs, queries, qrels, ks)
    for key, val in want.items():
        assert got[key] == pytest.approx(val, abs=1e-9), key


def _one_query(spark, qrels, extra=()):
    ds = [(f"d{i}", [1.0, 0.1 * i, 0.0]) for i in range(8)] + list(extra)
    idx = spark.createDataFrame(ds, "id string, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "qid string, v array<double>")
    qr = spark.createDataFrame(qrels, "query_id string, doc_id string, grade int")
    rows, _, _ = E.metric_rows(idx, "id", search.Dense("v", 3), q, "qid", search.Dense("v", 3), qr, k_values=(10,))
    return {(r["metric"], r["k"]): r["value"] for r in rows.collect()}


def test_a_judgement_given_twice_counts_once(spark):
    once = _one_query(spark, [("q", "d0", 1), ("q", "d3", 2)])
    assert _one_query(spark, [("q", "d0", 1), ("q", "d3", 2), ("q", "d0", 1), ("q", "d3", 1)]) == once
    assert once["map", 10] <= 1.0 and once["ndcg", 10] <= 1.0


def test_a_judged_document_without_a_vector_does_not_lead(spark):
    judged = [("q", "d5", 1), ("q", "x", 1), ("q", "w", 1)]
    got = _one_query(spark, judged, [("x", None), ("w", [1.0, 2.0])])
    assert abs(got["mrr", None] - 1 / 6) < 1e-9


def test_cap_of_two_million_wide_rows_equals_sorted_ids(spark):
    n, cap = 2_000_000, 1_000_000
    wide = spark.range(n).select("id", F.array(*[F.col("id").cast("double")] * 4).alias("v"))
    got = E.cap_by_id(wide, "id", cap)
    want = sorted(map(str, range(n)))[:cap]
    r = got.agg(F.count("*").alias("n"), F.max(F.col("id").cast("string")).alias("last"),
                F.sum("id").alias("s"), F.sum(F.element_at("v", 4)).alias("v")).first()
    assert (r["n"], r["last"]) == (cap, want[-1])
    assert r["s"] == sum(map(int, want)) == int(r["v"])
