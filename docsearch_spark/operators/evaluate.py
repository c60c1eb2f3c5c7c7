"""Dense-retrieval evaluation (E1-E14): caps, qrels filter, NDCG/MAP/Recall/P@k, MRR.

Shape of the job (all k values in one pass):

1. E1/E3 caps sort ids only, in a range-partitioned sort that is written once;
2. E4/E5/E6: the block grid keeps the top K = max(k) documents per query
   (identical ids removed) with ``v/(|v|+1e-12)`` cosine;
3. E7-E10: the <= K hits are left-joined to the qrels, a running count gives
   precision at each relevant rank, every hit row is expanded to the k values
   it counts for, and one ``groupBy(query, k)`` aggregates;
4. E11: MRR from the rank of each query's best relevant document in the full
   ranking (a counting scan, no sort), identical ids kept;
5. queries without a hit still count: everything starts from the query list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.operators import embed, search
from docsearch_spark.operators.chunking import doc_text
from docsearch_spark.session import materialize
from docsearch_spark.schemas import K_VALUES
from docsearch_spark.sources.files import check_dataset, load_eval_dataset

# Fixed values that must equal the application being re-built: the metric key
# prefixes of the report maps and the note of an empty evaluation.
METRIC_PREFIX = {"ndcg": "NDCG@", "map": "MAP@", "recall": "Recall@", "precision": "P@"}
METRIC_MAP_COLUMN = {"recall": "recall_at_k", "ndcg": "ndcg_at_k", "map": "map_at_k",
                     "precision": "precision_at_k"}
EMPTY_NOTE = ("No queries left after filtering qrels to embedded corpus; "
              "increase --max-corpus.")


# --------------------------------------------------------------------------
# E1, E2, E3


def first_ids(ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first ``n`` distinct ids, compared **as text**.

    Only ids are sorted. The range-partitioned sort is written once, with each
    row's partition, so counts and rows can never disagree on the partitions;
    whole partitions before the cut are taken, and the partition of the cut is
    cut by its own rows.
    """
    t = F.col(id_col).cast("string")
    ranked = materialize(
        ids.filter(F.col(id_col).isNotNull()).select(id_col).distinct().withColumn("__t", t)
        .repartitionByRange("__t").sortWithinPartitions("__t")
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked-ids")
    sizes = ranked.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    before = 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        if before + r["n"] > n:
            return ranked.filter((F.col("__part") < r["__part"]) | (
                (F.col("__part") == r["__part"]) & (F.col("__nth") < n - before))).select(id_col)
        before += r["n"]
    return ranked.select(id_col)


def cap_by_id(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Keep the rows of the first ``n`` ids compared **as text**; 0 keeps all.

    The wide table is never sorted: it meets the list of ids in a semi join."""
    if not n:
        return df
    return df.join(first_ids(df, id_col, n), id_col, "left_semi")


def filter_qrels(qrels: DataFrame, corpus_ids: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """E2 (and B9): grade > 0 and the document is in the (capped) corpus; one
    judgement per (query, document), the highest grade where several are given."""
    kept = (qrels.filter(F.col("grade") > 0)
            .join(corpus_ids.select(doc_col).distinct(), doc_col, "left_semi"))
    rest = [c for c in qrels.columns if c not in ("query_id", doc_col, "grade")]
    return kept.groupBy("query_id", doc_col).agg(
        F.max("grade").alias("grade"), *[F.first(c).alias(c) for c in rest]).select(*qrels.columns)


def cap_queries(qrels_f: DataFrame, max_queries: int) -> tuple[DataFrame, DataFrame]:
    """Surviving query ids sorted as text, first ``max_queries``; qrels restricted."""
    qids = qrels_f.select("query_id").distinct()
    qids = cap_by_id(qids, "query_id", max_queries)
    return qids, qrels_f.join(qids, "query_id", "left_semi")


# --------------------------------------------------------------------------
# E7-E10


def _k_table(spark, k_values) -> DataFrame:
    return spark.createDataFrame([(int(k),) for k in k_values], "k INT")


def metrics_at_k(hits: DataFrame, qrels_f: DataFrame, query_ids: DataFrame,
                 k_values=K_VALUES) -> DataFrame:
    """Per-query NDCG/MAP/Recall/P at every k.

    ``hits``: (query_id, doc_id, rank) with rank 1..K, identical ids removed.
    Returns (query_id, k, ndcg, map, recall, precision).
    """
    ks = sorted({int(k) for k in k_values})
    karr = F.array(*[F.lit(k) for k in ks])
    rel = qrels_f.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"))
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    # ideal DCG: the query's grades in descending order
    wi = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), F.col("doc_id"))
    ideal = (rel.withColumn("irank", F.row_number().over(wi))
             .filter(F.col("irank") <= F.lit(max(ks)))
             .select("query_id", "irank", "grade", F.explode(karr).alias("k"))
             .filter(F.col("irank") <= F.col("k"))
             .groupBy("query_id", "k")
             .agg(F.sum(F.col("grade") / F.log2(F.col("irank") + F.lit(1))).alias("idcg")))
    # actual: running count of relevant hits gives precision at each relevant rank
    wr = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = (hits.select("query_id", "doc_id", "rank").join(rel, ["query_id", "doc_id"], "left")
         .withColumn("is_rel", (F.coalesce(F.col("grade"), F.lit(0.0)) > 0).cast("int"))
         .withColumn("hits_upto", F.sum("is_rel").over(wr)))
    agg = (h.select("*", F.explode(karr).alias("k")).filter(F.col("rank") <= F.col("k"))
           .groupBy("query_id", "k")
           .agg(F.sum("is_rel").alias("n_hit"),
                F.sum(F.when(F.col("is_rel") == 1, F.col("hits_upto") / F.col("rank"))
                      .otherwise(F.lit(0.0))).alias("ap_sum"),
                F.sum(F.when(F.col("is_rel") == 1, F.col("grade") / F.log2(F.col("rank") + F.lit(1)))
                      .otherwise(F.lit(0.0))).alias("dcg")))
    base = query_ids.select("query_id", F.explode(karr).alias("k"))
    j = (base.join(agg, ["query_id", "k"], "left").join(ideal, ["query_id", "k"], "left")
         .join(n_rel, "query_id", "left"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("double")
    return j.select(
        "query_id", "k",
        F.coalesce(F.try_divide(F.coalesce(F.col("dcg"), F.lit(0.0)), F.col("idcg")), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.coalesce(F.col("ap_sum"), F.lit(0.0)), F.col("n_rel")), F.lit(0.0)).alias("map"),
        F.coalesce(F.try_divide(n_hit, F.col("n_rel")), F.lit(0.0)).alias("recall"),
        (n_hit / F.col("k")).alias("precision"))


def mean_metrics(per_query: DataFrame, k_values=K_VALUES, decimals: int = 5) -> DataFrame:
    """Mean over queries, rounded like the library does: (metric, k, value).

    With no queries every metric is 0.0 for each k (E13)."""
    spark = per_query.sparkSession
    m = per_query.groupBy("k").agg(*[F.avg(c).alias(c) for c in METRIC_PREFIX])
    ks = _k_table(spark, k_values)
    j = ks.join(m, "k", "left")
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"),
                                         F.round(F.coalesce(F.col(name), F.lit(0.0)), decimals).alias("value"))
                                for name in METRIC_PREFIX]))
    return j.select("k", stack.alias("s")).select("s.metric", "k", "s.value")


# --------------------------------------------------------------------------
# E11


def _unit_eps(spec, prefix: str) -> Column:
    """``v / (|v| + 1e-12)`` of a vector, once per row (dense: DOUBLE array;
    sparse: the weight array, buckets kept alongside)."""
    from docsearch_spark.functions.vectors import l2_normalize
    if isinstance(spec, search.Dense):
        return l2_normalize(spec.col).alias(prefix + "u")
    from docsearch_spark.functions.text import let
    w = let(F.sqrt(F.aggregate(F.col(spec.val), F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-12),
            lambda n: F.transform(F.col(spec.val), lambda x: x / n))
    return F.struct(F.col(spec.idx).alias("i"), w.alias("v")).alias(prefix + "u")


def _unit_dot(q_spec, d_spec) -> Column:
    """Dot product of the two unit vectors made by :func:`_unit_eps`."""
    from docsearch_spark.functions.text import let
    from docsearch_spark.functions.vectors import dot
    if isinstance(q_spec, search.Dense) and isinstance(d_spec, search.Dense):
        return dot("q_u", "d_u")
    if isinstance(q_spec, search.Sparse) and isinstance(d_spec, search.Sparse):
        return let(F.map_from_arrays(F.col("d_u.i"), F.col("d_u.v")), lambda m: F.aggregate(
            F.arrays_zip(F.col("q_u.i").alias("i"), F.col("q_u.v").alias("v")), F.lit(0.0),
            lambda a, e: a + e["v"] * F.coalesce(F.try_element_at(m, e["i"]), F.lit(0.0))))
    raise ValueError("query and index vectors must both be dense or both sparse")


def _row_dots(pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, sim): row-wise dot of the unit vectors q_u, d_u, one
    numpy product per Arrow batch (rounded like the ranking key)."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    schema = T.StructType([pairs.schema["query_id"], pairs.schema["doc_id"],
                           T.StructField("sim", T.DoubleType(), True)])
    dec = search.TIE_DECIMALS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            q, d = rb.column("q_u"), rb.column("d_u")
            lq = pc.fill_null(pc.list_value_length(q), 0).to_numpy()
            ld = pc.fill_null(pc.list_value_length(d), 0).to_numpy()
            sim = np.full(n, np.nan)
            ok = (lq == ld) & (lq > 0)
            if ok.all() and np.unique(lq).size == 1:
                dim = int(lq[0])
                qm = q.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                dm = d.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                sim = np.einsum("ij,ij->i", qm, dm)
            else:  # ragged rows: per row
                ql, dl = q.to_pylist(), d.to_pylist()
                for i in range(n):
                    if ok[i]:
                        sim[i] = float(np.dot(ql[i], dl[i]))
            yield pa.RecordBatch.from_arrays(
                [rb.column("query_id"), rb.column("doc_id"),
                 pa.array(np.round(sim, dec), type=pa.float64(), from_pandas=True)],
                names=["query_id", "doc_id", "sim"])

    return pairs.mapInArrow(run, schema)


def best_relevant(index: DataFrame, index_id: str, index_vec, queries: DataFrame, query_id: str,
                  query_vec, qrels_f: DataFrame) -> DataFrame:
    """(query_id, best_sim, best_doc): each query's best judged document by
    (score desc, id asc); only judged pairs are scored (equi-joins)."""
    qside = queries.select(F.col(query_id).alias("query_id"), _unit_eps(query_vec, "q_"))
    judged = qrels_f.select(F.col("doc_id").alias(index_id)).distinct()
    dside = (index.join(judged, index_id, "left_semi")
             .select(F.col(index_id).alias("doc_id"), _unit_eps(index_vec, "d_")))
    joined = qrels_f.select("query_id", "doc_id").join(qside, "query_id").join(dside, "doc_id")
    if isinstance(query_vec, search.Dense) and isinstance(index_vec, search.Dense):
        pairs = _row_dots(joined.select("query_id", "doc_id", "q_u", "d_u"))
    else:
        pairs = joined.select("query_id", "doc_id",
                              F.round(_unit_dot(query_vec, index_vec), search.TIE_DECIMALS).alias("sim"))
    # a pair without a score (a missing or misshapen vector) is never the best
    return (pairs.filter(F.col("sim").isNotNull()).groupBy("query_id")
            .agg(F.min(F.struct((-F.col("sim")).alias("neg"), F.col("doc_id").alias("d"))).alias("b"))
            .select("query_id", (-F.col("b.neg")).alias("best_sim"), F.col("b.d").alias("best_doc")))


def mrr_from_ranks(query_ids: DataFrame, ranks: DataFrame) -> DataFrame:
    """Mean of 1/rank over the query list (0 for a query without a rank; 0.0 with no queries)."""
    per_q = query_ids.join(ranks, "query_id", "left").select(
        "query_id", F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)).alias("rr"))
    return per_q.agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


# --------------------------------------------------------------------------
# E12, E13, E14


def metric_rows(index: DataFrame, index_id: str, index_vec, queries: DataFrame, query_id: str,
                query_vec, qrels: DataFrame, k_values=K_VALUES, max_corpus: int = 0,
                max_queries: int = 0):
    """E1-E11 in one job. Returns (metrics (metric, k, value) incl. mrr, num_queries df,
    corpus size df).

    One row per id is evaluated (the first of rows that repeat an id)."""
    corpus = materialize(cap_by_id(index, index_id, max_corpus).dropDuplicates([index_id]), "corpus")
    corpus_ids = corpus.select(F.col(index_id).alias("doc_id"))
    qrels_f = filter_qrels(qrels, corpus_ids)
    qids, qrels_f = cap_queries(qrels_f, max_queries)
    qrels_f = materialize(qrels_f, "qrels")  # small, read by several jobs below
    qids = qrels_f.select("query_id").distinct()
    qv = (queries.dropDuplicates([query_id])
          .join(qids.withColumnRenamed("query_id", query_id), query_id, "left_semi"))
    kmax = max(int(k) for k in k_values)
    # one pass over the corpus: the @k top-K (identical ids removed) and, for
    # MRR, the rank of each query's best relevant document (identical ids kept)
    targets = best_relevant(corpus, index_id, index_vec, qv, query_id, query_vec, qrels_f)
    tq = materialize(qv.withColumnRenamed(query_id, "query_id").join(targets, "query_id", "left"), "targets")
    hits, ranks = search.topk_scan(corpus, index_id, index_vec, tq, "query_id", query_vec, k=kmax,
                                   mode="cosine_eps", exclude_same_id=True,
                                   rank_targets=("best_sim", "best_doc"))
    ranks = ranks.join(targets.select("query_id"), "query_id", "left_semi")
    hits = materialize(hits, "hits")
    per_q = metrics_at_k(hits, qrels_f, qids, k_values)
    means = mean_metrics(per_q, k_values)
    m = mrr_from_ranks(qids, ranks)
    rows = means.unionByName(m.select(F.lit("mrr").alias("metric"), F.lit(None).cast("int").alias("k"),
                                      F.col("mrr").alias("value")))
    return rows, qids.agg(F.count(F.lit(1)).cast("int").alias("num_queries")), \
        corpus_ids.agg(F.count(F.lit(1)).alias("corpus_size"))


def metric_report(rows: DataFrame, num_queries: DataFrame, corpus_size: DataFrame, dataset: str,
                  notes: str, data_path: str = "") -> DataFrame:
    """One report row with the four ``Metric@k`` maps (entries in k
    order), mrr, num_queries, notes and extra{corpus_size, data_path}. With zero
    queries the metrics are 0.0 and the note says so.

    All inputs are unioned into one long table and reduced by one global
    aggregate (no joins).
    """
    long = (rows.select("metric", "k", "value")
            .unionByName(num_queries.select(F.lit("num_queries").alias("metric"),
                                            F.lit(None).cast("int").alias("k"),
                                            F.col("num_queries").cast("double").alias("value")))
            .unionByName(corpus_size.select(F.lit("corpus_size").alias("metric"),
                                            F.lit(None).cast("int").alias("k"),
                                            F.col("corpus_size").cast("double").alias("value"))))

    def entries(name, prefix):
        e = F.collect_list(F.when(F.col("metric") == name, F.struct(
            F.col("k").alias("k"), F.concat(F.lit(prefix), F.col("k").cast("string")).alias("key"),
            F.col("value").alias("value"))))
        return F.map_from_entries(F.transform(F.array_sort(e), lambda x: F.struct(x["key"], x["value"])))

    def scalar(name):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    agg = long.groupBy().agg(*[entries(n, p).alias(METRIC_MAP_COLUMN[n]) for n, p in METRIC_PREFIX.items()],
                             scalar("mrr").alias("mrr"), scalar("num_queries").alias("nq"),
                             scalar("corpus_size").alias("cs"))
    nq = F.coalesce(F.col("nq"), F.lit(0.0)).cast("int")
    return agg.select(
        F.lit(dataset).alias("dataset"), *[F.col(c) for c in METRIC_MAP_COLUMN.values()],
        F.when(nq > 0, F.coalesce(F.col("mrr"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("mrr"),
        nq.alias("num_queries"),
        F.when(nq > 0, F.lit(notes)).otherwise(F.lit(EMPTY_NOTE)).alias("notes"),
        F.create_map(F.lit("corpus_size"), F.col("cs").cast("long").cast("string"),
                     F.lit("data_path"), F.lit(data_path)).alias("extra"))


def evaluate_dataset(spark, folder: str, dataset: str, dim: int, k_values=K_VALUES, split: str = "test",
                     max_corpus: int = 0, max_queries: int = 0) -> DataFrame:
    """Load a dataset folder by its allowed name (A6), embed title and text with
    the default provider, evaluate (E1-E11), and report (E12)."""
    name = check_dataset(dataset)
    corpus, queries, qrels = load_eval_dataset(spark, folder, split, name)
    corpus = embed.embed_sparse(corpus.select("doc_id", doc_text(F.col("title"), F.col("text")).alias("t")), "t", dim)
    queries = embed.embed_sparse(queries.select("query_id", F.col("text").alias("t")), "t", dim)
    spec = search.Sparse("sv_idx", "sv_val", dim)
    rows, nq, cs = metric_rows(corpus, "doc_id", spec, queries, "query_id", spec, qrels, k_values,
                               max_corpus, max_queries)
    return metric_report(rows, nq, cs, name, f"dense retrieval on {name}", folder)
