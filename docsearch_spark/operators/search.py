"""Retrieval: cosine / L2 scoring and top-k.

Exact top-k for a table of questions (R3) works on a *block grid*: index rows
and question rows are dealt to groups by hash, so that a group's vectors fit
``CELL_BYTES``; every pair of groups is a cell. A row goes to each cell of its
group (index rows once for every group of questions, and the other way round),
and a cogroup brings the two sides of a cell together:

1. in a cell, tiles of questions and index rows are scored by one BLAS call each
   and only the best k a question are kept (ties by id), so a task holds two
   groups and one tile of scores, whatever the tables' sizes;
2. a ``row_number() <= k`` window (planned as ``WindowGroupLimit``) merges the k
   rows a question and cell, in two stages when there are many cells.

Nothing is gathered on the driver but two row counts. With few questions there
is one group of them, and the index is dealt once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.functions.text import col_
from docsearch_spark.functions.vectors import cosine_distance
from docsearch_spark.session import materialize
from docsearch_spark.schemas import NORM_EPS, TOP_K_DEFAULT, TOP_K_MAX, TOP_K_MIN

#: Bytes of index vectors in a cell of the grid; questions take a quarter of it.
CELL_BYTES = 32 * 1024 * 1024
TILE_INDEX, TILE_QUESTIONS = 8192, 256
#: Bytes of index rows that are dense doubles at a time; the rest of a cell stays as it came.
TILE_BYTES = 8 * 1024 * 1024
#: Cells whose rows one task merges for a question.
MERGE_CELLS = 256
#: Keys of rows without a score, and of rows that are left out.
UNSCORED, DROPPED = -1e300, -np.inf
# Scores equal to this many decimal places are ties (cut by id ascending), so
# results do not depend on floating-point summation order.
TIE_DECIMALS = 12


@dataclass(frozen=True)
class Dense:
    """An ARRAY<FLOAT|DOUBLE> vector column of the declared width ``dim``."""

    col: str
    dim: int


@dataclass(frozen=True)
class Sparse:
    """Parallel ARRAY<INT> bucket / ARRAY<DOUBLE> weight columns of width ``dim``."""

    idx: str
    val: str
    dim: int

    @property
    def cols(self):
        return [self.idx, self.val]


def _cols(spec) -> list[str]:
    return [spec.col] if isinstance(spec, Dense) else spec.cols


def clamp_top_k(k) -> Column:
    """``max(1, min(top_k, 50))``, missing top_k means 5."""
    return F.greatest(F.lit(TOP_K_MIN),
                      F.least(F.coalesce(col_(k), F.lit(TOP_K_DEFAULT)), F.lit(TOP_K_MAX))).cast("int")


# --------------------------------------------------------------------------
# Arrow batch -> matrix


def _matrix(rb: pa.RecordBatch, spec, dim: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(rows x dim float64 matrix, valid mask) of a batch's vector column(s)."""
    nb = rb.num_rows
    if isinstance(spec, Sparse):
        idx_col = rb.column(prefix + spec.idx)
        val_col = rb.column(prefix + spec.val)
        lens = pc.fill_null(pc.list_value_length(idx_col), 0).to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(nb), lens)
        mat = np.zeros((nb, dim), dtype=np.float64)
        if rows.size:
            flat_i = idx_col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            flat_v = val_col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            mat[rows, flat_i] = flat_v
        valid = np.asarray(idx_col.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        return mat, valid
    col = rb.column(prefix + spec.col)
    lens = pc.fill_null(pc.list_value_length(col), -1).to_numpy().astype(np.int64)
    valid = lens == dim
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    mat = np.zeros((nb, dim), dtype=np.float64)
    if valid.all() and flat.size == nb * dim:
        mat = flat.reshape(nb, dim)
    elif valid.any():
        starts = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))[:-1]])
        vr = np.flatnonzero(valid)
        mat[vr] = flat[starts[vr][:, None] + np.arange(dim)[None, :]]
    bad = np.isnan(mat).any(axis=1)
    valid &= ~bad
    mat[~valid] = 0.0
    return mat, valid


def _prepare(mat: np.ndarray, valid: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalise rows for the scoring mode; returns (matrix, scorable mask)."""
    if mode == "l2":
        return mat, valid
    n = np.linalg.norm(mat, axis=1)
    if mode == "cosine_eps":  # evaluation: v / (|v| + 1e-12), a zero vector scores 0
        return mat / (n[:, None] + NORM_EPS), valid
    ok = valid & (n > 0)      # retrieval: a zero vector has no cosine
    out = np.zeros_like(mat)
    out[ok] = mat[ok] / n[ok, None]
    return out, ok


def _arrow_type(dt: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dt)


def _score_cell(index: pa.Table, asked: pa.Table, index_vec, query_vec, dim: int, mode: str,
                kmax: int, exclude_same: bool, ranked: bool, schema: pa.Schema) -> pa.Table:
    """One cell of the grid: the best ``kmax`` index rows of each question, and,
    with ``ranked``, how many come before its target (marked by top_k -1)."""
    if not index.num_rows or not asked.num_rows:
        return schema.empty_table()
    ids = index.column("id").to_pylist()
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=ids.__getitem__)
    index = index.take(pa.array(order, pa.int64()))  # by id: equal scores are cut by position
    ids = [ids[i] for i in order]
    qmat, qvalid = _matrix(_one_batch(asked), query_vec, dim, "q_")
    qn, qok = _prepare(qmat, qvalid, mode)
    n, m = len(qok), len(ids)
    tile = max(1, min(TILE_INDEX, TILE_BYTES // (8 * dim)))
    qids = asked.column("query_id")
    own = np.full(n, -1)
    if exclude_same:  # ids are compared as text
        place = {str(x): i for i, x in enumerate(ids)}
        own = np.array([place.get(str(x), -1) for x in qids.to_pylist()], np.int64)
    thr = before = None
    if ranked:
        thr = asked.column("thr").to_numpy().astype(np.float64)
        before = np.array([bisect.bisect_left(ids, x) if x is not None else 0
                           for x in asked.column("tid").to_pylist()], np.int64)
    counts = np.zeros(n, np.int64)
    best_key = np.full((n, 0), DROPPED)
    best_at = np.zeros((n, 0), np.int64)
    for c0 in range(0, m, tile):
        c1 = min(m, c0 + tile)
        cn, cok = _prepare(*_matrix(_one_batch(index.slice(c0, c1 - c0)), index_vec, dim), mode)
        keys, ats = [], []
        for q0 in range(0, n, TILE_QUESTIONS):
            q1 = min(n, q0 + TILE_QUESTIONS)
            dots = qn[q0:q1] @ cn.T
            if mode == "l2":
                sq = (qn[q0:q1] ** 2).sum(1)[:, None] + (cn ** 2).sum(1)[None, :] - 2.0 * dots
                key = -np.sqrt(np.maximum(sq, 0.0))
            else:
                key = np.round(dots, TIE_DECIMALS)
            key[~qok[q0:q1]] = UNSCORED
            key[:, ~cok] = UNSCORED
            if ranked:  # identical ids count here
                t = thr[q0:q1, None]
                counts[q0:q1] += ((key > t) | ((key == t) & (np.arange(c0, c1) < before[q0:q1, None]))).sum(1)
            mine = np.flatnonzero((own[q0:q1] >= c0) & (own[q0:q1] < c1))
            key[mine, own[q0:q1][mine] - c0] = DROPPED
            at = _first_best(key, min(kmax, c1 - c0))
            keys.append(np.take_along_axis(key, at, 1))
            ats.append(at + c0)
        key = np.concatenate([best_key, np.concatenate(keys)], axis=1)
        at = np.concatenate([best_at, np.concatenate(ats)], axis=1)
        top = np.argsort(-key, axis=1, kind="stable")[:, :kmax]
        best_key, best_at = np.take_along_axis(key, top, 1), np.take_along_axis(at, top, 1)
    q, slot = np.nonzero(best_key > DROPPED)
    at, value = best_at[q, slot], best_key[q, slot]
    for i in range(0, len(q), tile):  # the exact score of the rows that are left
        asked_at = q[i:i + tile]
        vec, valid = _matrix(_one_batch(index.take(pa.array(at[i:i + tile]))), index_vec, dim)
        cn, cok = _prepare(vec, valid, mode)
        exact = (np.sqrt(((qmat[asked_at] - vec) ** 2).sum(1)) if mode == "l2"
                 else np.einsum("ij,ij->i", qn[asked_at], cn))
        value[i:i + tile] = np.where(qok[asked_at] & cok, exact, np.nan)
    hits = pa.table({"query_id": qids.take(pa.array(q)), "doc_id": index.column("id").take(pa.array(at)),
                     "value": pa.array(value, pa.float64(), from_pandas=True),
                     "top_k": asked.column("top_k").take(pa.array(q))})
    if ranked:
        hits = pa.concat_tables([hits.cast(schema), pa.table({
            "query_id": qids, "doc_id": pa.nulls(n, schema.field("doc_id").type),
            "value": pa.array(counts.astype(np.float64)), "top_k": pa.array(np.full(n, -1, np.int32))}
        ).cast(schema)])
    return hits.cast(schema)


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    batches = table.combine_chunks().to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)


def _first_best(key: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest keys of each row, ascending; of equal ones the first."""
    n, m = key.shape
    if k <= 0 or not n:
        return np.zeros((n, 0), np.int64)
    if m == k:
        return np.broadcast_to(np.arange(m), (n, m))
    kth = np.partition(key, m - k, axis=1)[:, m - k, None]
    mask = key >= kth
    over = np.flatnonzero(mask.sum(1) > k)
    if len(over):
        more, ties = key[over] > kth[over], key[over] == kth[over]
        room = k - more.sum(1, keepdims=True)
        mask[over] = more | (ties & (np.cumsum(ties, axis=1) <= room))
    return np.nonzero(mask)[1].reshape(n, k)


def topk_scan(index: DataFrame, index_id: str, index_vec, queries: DataFrame, query_id: str,
              query_vec, k: int | None = None, k_col: Column | None = None,
              mode: str = "cosine", exclude_same_id: bool = False, rank_targets=None,
              cell_bytes: int = CELL_BYTES):
    """Exact top-k of ``index`` for every row of ``queries`` (R3, E4/E5 truncated).

    The vector specs declare the width; a vector of another width, or with a NULL
    or NaN inside, cannot be scored (C5 reports such rows). Both tables should be
    stored ones: each is counted, which sets the grid, and read once.

    With ``rank_targets = (score_col, id_col)`` the same pass also counts, per
    question, the rows ranked before the target (identical ids kept), and
    ``(hits, ranks)`` is returned, ``ranks`` being ``(query_id, rank)`` of the
    target in the full ranking. ``k = 0`` counts only.

    ``mode``: ``cosine`` (NULL for zero vectors, as the ``<=>`` operator),
    ``cosine_eps`` (``v/(|v|+1e-12)``, zero vectors score 0, used by the
    evaluation), ``l2`` (Euclidean distance, ascending).

    Returns ``query_id, doc_id, value DOUBLE, rank INT`` with ``rank <= k``
    (per-question ``k_col`` is cut to at most ``k`` when both are given).
    """
    if k is None and k_col is None:
        k = TOP_K_DEFAULT
    kexpr = F.lit(k) if k_col is None else (k_col if k is None else F.least(k_col, F.lit(k)))
    dim = index_vec.dim
    if query_vec.dim != dim:
        raise ValueError(f"question vectors have width {query_vec.dim}, index vectors {dim}")
    kmax = k if k is not None else TOP_K_MAX
    per_row = dim * 8 + 64
    groups = max(1, -(-index.count() * per_row // cell_bytes))
    asked_groups = max(1, -(-queries.count() * per_row * 4 // cell_bytes))
    idx = index.select(F.col(index_id).alias("id"), *[F.col(c).alias(c) for c in _cols(index_vec)],
                       F.pmod(F.xxhash64(index_id), F.lit(groups)).cast("int").alias("g"),
                       F.explode(F.sequence(F.lit(0), F.lit(asked_groups - 1))).alias("h"))
    asked = [F.col(query_id).alias("query_id"), *[F.col(c).alias("q_" + c) for c in _cols(query_vec)],
             F.coalesce(kexpr.cast("int"), F.lit(0)).alias("top_k"),
             F.pmod(F.xxhash64(query_id), F.lit(asked_groups)).cast("int").alias("h")]
    if rank_targets is not None:
        asked += [F.round(F.col(rank_targets[0]), TIE_DECIMALS).alias("thr"),
                  F.col(rank_targets[1]).alias("tid")]
    asked_rows = queries.select(*asked).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    out = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType, True),
        T.StructField("doc_id", index.schema[index_id].dataType, True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("top_k", T.IntegerType(), True)])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in out])
    ranked = rank_targets is not None

    def cell(index_rows: pa.Table, question_rows: pa.Table) -> pa.Table:
        return _score_cell(index_rows, question_rows, index_vec, query_vec, dim, mode, kmax,
                           exclude_same_id, ranked, arrow)

    cand = idx.groupBy("g", "h").cogroup(asked_rows.groupBy("g", "h")).applyInArrow(cell, out)
    if ranked:
        # small (k rows and a count per question and cell), read by two aggregations
        cand = materialize(cand, "cells")
    rounded = F.round(F.col("value"), TIE_DECIMALS)
    order = rounded.asc_nulls_last() if mode == "l2" else rounded.desc_nulls_last()
    w = Window.partitionBy("query_id").orderBy(order, F.col("doc_id").asc())
    kept = cand.filter(F.col("top_k") >= 0)
    if groups > MERGE_CELLS:  # two stages: no task merges more than MERGE_CELLS x k rows of a question
        salts = -(-groups // MERGE_CELLS)
        part = Window.partitionBy("query_id", "salt").orderBy(order, F.col("doc_id").asc())
        kept = (kept.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
                .withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= F.lit(kmax))
                .drop("salt", "rank"))
    hits = (kept.withColumn("rank", F.row_number().over(w))
            .filter((F.col("rank") <= F.lit(kmax)) & (F.col("rank") <= F.col("top_k")))
            .drop("top_k"))
    if not ranked:
        return hits
    ranks = (cand.filter(F.col("top_k") == -1).groupBy("query_id")
             .agg((F.sum("value").cast("long") + F.lit(1)).alias("rank")))
    return hits, ranks


def attach(hits: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Join top-k hits back to a (large) table on ``key``; the planner picks the join."""
    return hits.join(table, key)


# --------------------------------------------------------------------------
# Expression forms


def with_cosine_distance(df: DataFrame, a, b, out: str = "dist") -> DataFrame:
    """``a <=> b`` as a column (NULL for zero vectors)."""
    return df.withColumn(out, cosine_distance(a, b))


def topk_single(index: DataFrame, vec_col: str, query_vec: list[float], k: int = TOP_K_DEFAULT,
                id_col: str = "chunk_id") -> DataFrame:
    """R2: ``ORDER BY embedding <=> q LIMIT k`` for one question vector.

    The single vector is a literal, so the plan is scan -> project ->
    ``TakeOrderedAndProject`` (a per-task top-k, then a merge of k rows each).
    Ties are cut by id (the reference leaves them unspecified).
    """
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    scored = index.withColumn("dist", cosine_distance(vec_col, q))
    return (scored.orderBy(F.col("dist").asc_nulls_last(), F.col(id_col).asc()).limit(k)
            .withColumn("score", F.lit(1.0) - F.col("dist")))


# --------------------------------------------------------------------------
# Random-hyperplane approximate search


#: Planes of one table at most: plane ``t * MAX_BITS + b`` is bit b of table t.
MAX_BITS = 48
#: Rows that a bucket holds on average: the bits of a key grow with the index.
BUCKET_ROWS = 16


def plane_signs(p: int, dim: int) -> list[float]:
    """Plane p: sign in dimension d is +1 when the first hex digit of
    ``md5(p || ':' || d)`` is below '8', else -1 (a formula, not stored data)."""
    import hashlib
    return [1.0 if hashlib.md5(f"{p}:{d}".encode()).hexdigest()[0] < "8" else -1.0
            for d in range(dim)]


def key_bits(rows: int) -> int:
    """Bits of a bucket key, so that buckets hold about ``BUCKET_ROWS`` rows at any size."""
    buckets = -(-max(1, rows) // BUCKET_ROWS)
    return min(MAX_BITS, buckets.bit_length())


#: Ids that a task's shard of buckets holds on average, and of a bucket's block at most.
SHARD_IDS, BLOCK_IDS = 8192, 8192


def lsh_buckets(rows: DataFrame, id_col: str, vec_col: str, dim: int, n_tables: int, n_bits: int,
                named_only: bool = False) -> DataFrame:
    """(id, vecs, bucket): every id with its vectors, once for each bucket that one of them falls
    into; ``named_only`` gives the buckets alone.

    Bucket ``table * 2 ** MAX_BITS + key``, bit of a key = dot(v, plane) >= 0: one product with all
    planes per Arrow batch. Vectors of another width have no key; a null id is left out.
    """
    planes = np.array([plane_signs(t * MAX_BITS + b, dim) for t in range(n_tables) for b in range(n_bits)])
    powers = 1 << np.arange(n_bits, dtype=np.int64)
    first = np.arange(n_tables, dtype=np.int64) << MAX_BITS
    held = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(vec_col).alias("v")))).alias("vecs"))
    schema = T.StructType(([] if named_only else held.schema.fields) + [T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # its rows come n_tables times
                rb = whole.slice(at, 1024)
                lens, mat, valid = _vectors(rb, dim)
                rows = np.flatnonzero(valid)
                own = np.repeat(np.repeat(np.arange(rb.num_rows), lens)[rows], n_tables)
                bits = (mat[rows] @ planes.T >= 0).reshape(len(rows), n_tables, n_bits)
                bucket = ((bits * powers).sum(axis=2) + first).ravel()
                if (lens > 1).any():
                    own, bucket = np.unique(np.stack([own, bucket]), axis=1)
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    ([] if named_only else [c.take(pick) for c in rb.columns]) + [pa.array(bucket, pa.int64())],
                    names=schema.names)

    return held.mapInArrow(run, schema)


def _vectors(rb: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of each row, all of them as a matrix, valid mask) of a batch's ``vecs``."""
    vecs = rb.column("vecs")
    flat = pa.RecordBatch.from_arrays([vecs.flatten().field(0)], names=["v"])
    return pc.list_value_length(vecs).to_numpy().astype(np.int64), *_matrix(flat, Dense("v", dim), dim)


def _in_cells(table: pa.Table, dim: int):
    """One side of a shard by (bucket, part, id): cells' first and last rows by name, each row's id
    and its number among the id's vectors, unit vectors, scorable mask."""
    rb = _one_batch(table.combine_chunks().sort_by([(c, "ascending") for c in ("bucket", "part", "id")]))
    lens, mat, valid = _vectors(rb, dim)
    unit, ok = _prepare(mat, valid, "cosine")
    own = np.repeat(np.arange(rb.num_rows), lens)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(lens) - lens, lens)
    bucket, part = (rb.column(c).to_numpy()[own] for c in ("bucket", "part"))
    start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
    cells = dict(zip(zip(bucket[start].tolist(), part[start].tolist()), zip(start, np.r_[start[1:], len(own)])))
    return cells, rb.column("id").take(pa.array(own)), nth, unit, ok


def _score_shard(index: pa.Table, asked: pa.Table, dim: int, k: int, schema: pa.Schema) -> pa.Table:
    """The best ``k`` index rows of each question row in each of the shard's cells, ties by id."""
    if not index.num_rows or not asked.num_rows:
        return schema.empty_table()
    cells, ids, nth, unit, ok = _in_cells(index, dim)
    asked_cells, asked_ids, asked_nth, asked_unit, asked_ok = _in_cells(asked, dim)
    qs, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name, (q_first, q_last) in asked_cells.items():
        if name not in cells:
            continue
        first, last = cells[name]
        for q0 in range(q_first, q_last, TILE_QUESTIONS):
            q1 = min(q_last, q0 + TILE_QUESTIONS)
            key = np.round(asked_unit[q0:q1] @ unit[first:last].T, TIE_DECIMALS)
            key[~asked_ok[q0:q1]] = UNSCORED
            key[:, ~ok[first:last]] = UNSCORED
            best = _first_best(key, min(k, last - first))
            qs.append(np.repeat(np.arange(q0, q1), best.shape[1]))
            ats.append(best.ravel() + first)
    q, at = np.concatenate(qs), np.concatenate(ats)
    value = np.zeros(len(q))
    for i in range(0, len(q), TILE_INDEX):
        a, b = q[i:i + TILE_INDEX], at[i:i + TILE_INDEX]
        value[i:i + TILE_INDEX] = np.where(asked_ok[a] & ok[b], np.einsum("ij,ij->i", asked_unit[a], unit[b]), np.nan)
    return pa.table([asked_ids.take(pa.array(q)).cast(schema[0].type), pa.array(asked_nth[q], pa.int32()),
                     ids.take(pa.array(at)).cast(schema[2].type), pa.array(nth[at], pa.int32()),
                     pa.array(value, pa.float64(), from_pandas=True)], schema=schema)


def ann_candidates(index: DataFrame, index_id: str, queries: DataFrame, query_id: str, vec_col: str,
                   dim: int, k: int, n_tables: int, n_bits: int) -> DataFrame:
    """(query_id, q_nth, doc_id, d_nth, score): of every bucket the ``k`` best index rows of each
    question in it. A pair comes once for each bucket it shares and is best in.

    The rows go to their buckets with their vectors, so pairs are scored where they meet and
    only hits are handed on: what is shuffled grows with the rows, not with the pairs. Buckets
    are dealt to shards of about ``SHARD_IDS`` ids; one with more than ``BLOCK_IDS`` (many equal
    vectors) is a grid of blocks, each a cell. Nothing is dropped that could be among the k best.
    """
    rows = max(index.count(), queries.count())
    shards = max(1, -(-rows * n_tables // SHARD_IDS))
    sides = (index, index_id), (queries, query_id)
    names = [lsh_buckets(df, key, vec_col, dim, n_tables, n_bits, True) for df, key in sides]
    one, none = F.lit(1), F.lit(0)
    counted = names[0].select("bucket", one.alias("i"), none.alias("q")).unionByName(
        names[1].select("bucket", none.alias("i"), one.alias("q"))).groupBy("bucket").agg(
        F.sum("i").alias("i"), F.sum("q").alias("q"))
    hot = materialize(counted.where(F.greatest("i", "q") > BLOCK_IDS).select(
        "bucket", *[F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_IDS)).cast("int").alias(c) for c in ("i", "q")]), "hot")
    split = not hot.isEmpty()

    def side(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        rows = lsh_buckets(df, key, vec_col, dim, n_tables, n_bits)
        part = F.lit(0).cast("long")
        if split:
            rows = rows.join(hot, "bucket", "left").fillna(1, ["i", "q"])
            rows = rows.withColumn("__own", F.pmod(F.xxhash64("id"), F.col(own))).withColumn(
                "__other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            part = (F.col("__own" if own == "i" else "__other").cast("long") * (1 << 31)
                    + F.col("__own" if own == "q" else "__other"))
        rows = rows.withColumn("part", part)
        return rows.select("id", "vecs", "bucket", "part",
                           F.pmod(F.xxhash64("bucket", "part"), F.lit(shards)).cast("int").alias("shard"))

    schema = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("q_nth", T.IntegerType()),
        T.StructField("doc_id", index.schema[index_id].dataType), T.StructField("d_nth", T.IntegerType()),
        T.StructField("score", T.DoubleType())])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])

    def cell(index_rows: pa.Table, question_rows: pa.Table) -> pa.Table:
        return _score_shard(index_rows, question_rows, dim, k, arrow)

    return (side(index, index_id, "i", "q").groupBy("shard")
            .cogroup(side(queries, query_id, "q", "i").groupBy("shard")).applyInArrow(cell, schema))


def ann_topk(index: DataFrame, index_id: str, queries: DataFrame, query_id: str, vec_col: str,
             dim: int, k: int = 10, n_tables: int = 8, n_bits: int | None = None) -> DataFrame:
    """Candidates by hyperplane buckets, exact cosine rank, top k.

    ``n_bits`` (default: :func:`key_bits` of the index's row count) keeps the
    number of candidates per question level as the index grows. Rows with equal ids are
    rows of their own, found by the buckets of all of them; a vector without a direction
    has no score and comes last.
    """
    if n_bits is None:
        n_bits = key_bits(index.count())
    found = ann_candidates(index, index_id, queries, query_id, vec_col, dim, k, n_tables, n_bits)
    scored = found.repartition("query_id").groupBy("query_id", "q_nth", "doc_id", "d_nth").agg(
        F.max("score").alias("score")).select("query_id", "doc_id", "score")
    w = Window.partitionBy("query_id").orderBy(F.round(F.col("score"), TIE_DECIMALS).desc_nulls_last(),
                                               F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ann_recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Per question, share of the exact top-k that the approximate top-k returns."""
    e = exact.select("query_id", "doc_id").withColumn("__one", F.lit(1))
    a = approx.select("query_id", "doc_id").withColumn("__hit", F.lit(1))
    return (e.join(a, ["query_id", "doc_id"], "left")
            .groupBy("query_id")
            .agg((F.sum(F.coalesce("__hit", F.lit(0))) / F.count("__one")).alias("recall")))


# --------------------------------------------------------------------------
# rank of a given (score, id) pair in a full ranking, without sorting


def rank_in_full_ranking(index: DataFrame, index_id: str, index_vec, targets: DataFrame,
                         query_id: str, query_vec, score_col: str, target_id_col: str,
                         mode: str = "cosine_eps") -> DataFrame:
    """Rank (1-based) that the pair (score, target id) of each question would get in
    the question's full ranking of ``index`` (score desc, id asc).

    Equals ``1 + #{d : s(q,d) > s or (s(q,d) = s and d < id)}``, counted cell by
    cell on the grid of :func:`topk_scan`. Scores are compared at ``TIE_DECIMALS``
    places so that the target's own score, computed elsewhere, ties with itself.
    """
    _, ranks = topk_scan(index, index_id, index_vec, targets, query_id, query_vec, k=0, mode=mode,
                         rank_targets=(score_col, target_id_col))
    return ranks
