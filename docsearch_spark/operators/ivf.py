"""Approximate search on a trained, stored index (R4): inverted lists of product codes.

* **Train** (``build``): k-means centroids and, on what they leave over, one codebook a
  subspace, fitted in numpy on a bounded sample (the rows of least hash, at most
  ``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` bytes). Only the fit is sampled.
* **Store**: every vector goes to the list of its nearest centroid, as a row (id, list,
  code, vector) of a Parquet table partitioned by list. ``insert`` encodes further rows
  with the stored model and appends those whose id is new, so a repeated insert adds
  nothing. A hot list is written and searched in blocks.
* **Search** (``topk``): questions go to their ``probes`` nearest lists and meet the lists'
  codes in cells of bounded size (question group x list block); table lookups rate every
  code there, the best ``depth`` a question meet their vectors, and exact cosine ranks them.
* **Tune** (``tune``): on a bounded set of questions with exact answers, the fewest probes
  whose lists hold enough of the answers, then the least depth that reaches the target.
  Both are stored with the index.

Vectors of another width, with a NULL or NaN inside, or of zero length have no cosine and
are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.functions.vectors import cosine_distance
from docsearch_spark.operators.search import (DROPPED, TIE_DECIMALS, Dense, _arrow_type, _first_best, _matrix,
                                              _prepare, topk_scan)
from docsearch_spark.session import materialize

#: Rows and bytes of the sample that centroids and codebooks are fitted on.
TRAIN_ROWS, TRAIN_BYTES = 16_384, 32 << 20
ROUNDS = 12
#: Lists: about the square root of the rows, within these bounds.
LEAST_LISTS, MOST_LISTS = 16, 4096
#: Dimensions of a subspace, and codes of a codebook (one byte).
SUBSPACE, CODES = 4, 256
#: Rows of a list block and questions of a group: what a cell of the search holds.
BLOCK_ROWS, GROUP_QUESTIONS = 32_768, 4096
TILE_ROWS, TILE_QUESTIONS = 8192, 128
#: Questions that the settings are measured on.
TUNE_QUESTIONS = 256


@dataclass(frozen=True)
class Ivf:
    """A stored index: its folder, its model and its settings."""

    path: str
    centroids: np.ndarray   # lists x dim
    codebooks: np.ndarray   # subspaces x codes x SUBSPACE
    dim: int
    probes: int
    depth: int

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of rows ``x``; the first k rows (of least hash) start, empty ones stay."""
    c = x[:k].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def closeness(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The larger, the nearer: x.c - |c|^2 / 2."""
    return x @ c.T - (c ** 2).sum(1) / 2


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([closeness(x[i:i + TILE_ROWS], c).argmax(1) for i in range(0, len(x), TILE_ROWS)]
                          or [np.zeros(0, np.int64)])


def padded(x: np.ndarray) -> np.ndarray:
    """Rows as subspaces: n x subspaces x SUBSPACE, zeros behind the last dimension."""
    n, dim = x.shape
    parts = -(-dim // SUBSPACE)
    out = np.zeros((n, parts * SUBSPACE))
    out[:, :dim] = x
    return out.reshape(n, parts, SUBSPACE)


def unit_rows(batch: pa.RecordBatch, col: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, positions) of the rows of a batch that have a direction."""
    mat, valid = _matrix(batch, Dense(col, dim), dim)
    unit, ok = _prepare(mat, valid, "cosine")
    at = np.flatnonzero(ok)
    return unit[at], at


def fit(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, codebooks) from the bounded sample."""
    total = rows.count()
    most = min(TRAIN_ROWS, max(CODES, TRAIN_BYTES // (8 * dim)))
    order = F.xxhash64(F.col(id_col).cast("string"))
    sample = rows.select(vec_col, order.alias("h"), id_col).orderBy("h", id_col).limit(most).select(vec_col)
    table = sample.toArrow().combine_chunks()
    batches = table.to_batches()
    x = unit_rows(batches[0], vec_col, dim)[0] if batches else np.zeros((0, dim))
    if not len(x):
        raise ValueError("no vector with a direction to train on")
    lists = min(MOST_LISTS, max(LEAST_LISTS, 1 << (int(total ** 0.5).bit_length() - 1)), len(x))
    centroids = kmeans(x, lists)
    rest = padded(x - centroids[nearest(x, centroids)])
    books = np.stack([kmeans(rest[:, p], min(CODES, len(x))) for p in range(rest.shape[1])])
    return centroids, books


def encoded(rows: DataFrame, id_col: str, vec_col: str, centroids: np.ndarray, books: np.ndarray,
            dim: int) -> DataFrame:
    """(id, list, code, vec) of every row that has a direction."""
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("list", T.IntegerType()),
                           T.StructField("code", T.BinaryType()), T.StructField("vec", rows.schema[vec_col].dataType)])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = unit_rows(batch, "vec", dim)
            own = nearest(x, centroids)
            rest = padded(x - centroids[own])
            code = np.stack([nearest(rest[:, p], books[p]) for p in range(len(books))], 1).astype(np.uint8)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pick).cast(arrow[0].type), pa.array(own, pa.int32()),
                 pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vec").take(pick).cast(arrow[3].type)],
                schema=arrow)

    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, schema)


def _append(rows: DataFrame, path: str) -> None:
    # rebalance: one list's rows in few files, a hot list in several
    rows.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{path}/lists")


def build(rows: DataFrame, id_col: str, vec_col: str, dim: int, path: str) -> Ivf:
    """Train on ``rows`` (one row an id), store the model and every row under ``path``."""
    spark = rows.sparkSession
    centroids, books = fit(rows, id_col, vec_col, dim)
    model = [("centroid", i, 0, c.tolist()) for i, c in enumerate(centroids)]
    model += [("code", p, i, c.tolist()) for p, book in enumerate(books) for i, c in enumerate(book)]
    spark.createDataFrame(model, "kind string, part int, nth int, vec array<double>").coalesce(1) \
        .write.parquet(f"{path}/model")
    index = Ivf(path, centroids, books, dim, len(centroids), 10 * CODES)
    _save(spark, index)
    _append(encoded(rows, id_col, vec_col, centroids, books, dim), path)
    return index


def insert(spark: SparkSession, index: Ivf, rows: DataFrame, id_col: str, vec_col: str) -> None:
    """Append the rows whose id the index has not got; the model stays."""
    held = index.lists(spark).select(F.col("id").alias(id_col))
    fresh = rows.dropDuplicates([id_col]).join(held, id_col, "left_anti")
    _append(materialize(encoded(fresh, id_col, vec_col, index.centroids, index.codebooks, index.dim), "insert"),
            index.path)


def _save(spark: SparkSession, index: Ivf) -> None:
    spark.createDataFrame([(index.dim, index.probes, index.depth)], "dim int, probes int, depth int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{index.path}/settings")


def open_index(spark: SparkSession, path: str) -> Ivf:
    """The index stored under ``path``; its model is bounded by the parameters above."""
    own = spark.read.parquet(f"{path}/settings").first()
    model = spark.read.parquet(f"{path}/model")
    centroids = np.array([r["vec"] for r in model.where("kind = 'centroid'").orderBy("part").collect()])
    codes = model.where("kind = 'code'").orderBy("part", "nth").collect()
    parts = 1 + max(r["part"] for r in codes)
    books = np.array([r["vec"] for r in codes]).reshape(parts, -1, SUBSPACE)
    return Ivf(path, centroids, books, own["dim"], own["probes"], own["depth"])


# --------------------------------------------------------------------------
# search


def probed(queries: DataFrame, query_id: str, vec_col: str, index: Ivf, held: np.ndarray | None = None) -> DataFrame:
    """(query_id, qv, turn, list): each question once for each list it looks into, nearest
    first: ``probes`` lists, and more where those hold (``held``, rows a list) fewer than
    ``depth`` rows."""
    depth, centroids, probes, dim = index.depth, index.centroids, min(index.probes, len(index.centroids)), index.dim
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType),
                           T.StructField("qv", T.ArrayType(T.FloatType())),
                           T.StructField("lists", T.ArrayType(T.IntegerType()))])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = unit_rows(batch, "qv", dim)
            near = np.argsort(-closeness(x, centroids), axis=1, kind="stable").astype(np.int32)
            take = np.full(len(near), probes)
            if held is not None:
                take = np.maximum(take, 1 + (np.cumsum(held[near], axis=1) < depth).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(at)).cast(arrow[0].type),
                 pa.array(list(x.astype(np.float32)), arrow[1].type),
                 pa.array([r[:n] for r, n in zip(near, take)], arrow[2].type)], schema=arrow)

    return (queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("qv")).mapInArrow(run, schema)
            .select("query_id", "qv", F.posexplode("lists").alias("turn", "list")))


def candidates(index: Ivf, queries: DataFrame, query_id: str, vec_col: str) -> DataFrame:
    """(query_id, id, list, near, place): the best ``depth`` codes of each question."""
    spark = queries.sparkSession
    stored = index.lists(spark)
    held = np.zeros(len(index.centroids), np.int64)
    for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list
        held[r["list"]] = r["n"]
    blocks = F.element_at(F.array(*[F.lit(max(1, int(-(-n // BLOCK_ROWS)))) for n in held]), F.col("list") + 1)
    groups = max(1, -(-queries.count() // GROUP_QUESTIONS))
    rows = (stored.select("id", "list", "code", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
            .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    asked = (probed(queries, query_id, vec_col, index, held).drop("turn")
             .withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
             .withColumn("grp", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")))
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType),
                           T.StructField("id", stored.schema["id"].dataType), T.StructField("list", T.IntegerType()),
                           T.StructField("near", T.DoubleType())])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])
    centroids, books, depth = index.centroids, index.codebooks, index.depth

    def cell(codes: pa.Table, questions: pa.Table) -> pa.Table:
        if not codes.num_rows or not questions.num_rows:
            return arrow.empty_table()
        codes = codes.sort_by("id")  # equal codes are cut by id
        own = codes["list"][0].as_py()
        code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        q = np.array(questions["qv"].to_pylist(), float)
        found = []
        for q0 in range(0, len(q), TILE_QUESTIONS):
            x = q[q0:q0 + TILE_QUESTIONS]
            table = np.einsum("qps,pcs->pqc", padded(x), books)
            key, at = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64)
            for c0 in range(0, len(code), TILE_ROWS):
                part = code[c0:c0 + TILE_ROWS]
                near = np.repeat((x @ centroids[own])[:, None], len(part), 1)
                for p in range(len(books)):
                    near += table[p][:, part[:, p]]
                near = np.round(near, TIE_DECIMALS)
                best = _first_best(near, min(depth, len(part)))
                key = np.concatenate([key, np.take_along_axis(near, best, 1)], 1)
                at = np.concatenate([at, best + c0], 1)
                top = np.argsort(-key, axis=1, kind="stable")[:, :depth]
                key, at = np.take_along_axis(key, top, 1), np.take_along_axis(at, top, 1)
            row, slot = np.nonzero(key > DROPPED)
            found.append(pa.table([
                questions["query_id"].take(pa.array(row + q0)).cast(arrow[0].type),
                codes["id"].take(pa.array(at[row, slot])).cast(arrow[1].type),
                pa.array(np.full(len(row), own, np.int32)), pa.array(key[row, slot])], schema=arrow))
        return pa.concat_tables(found)

    on = "list", "block", "grp"
    met = rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(cell, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= depth)


def topk(index: Ivf, queries: DataFrame, query_id: str, vec_col: str, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` by exact cosine among the candidates."""
    spark = queries.sparkSession
    found = candidates(index, queries, query_id, vec_col).select("query_id", "id", "list")
    vectors = index.lists(spark).select("id", "list", "vec")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("qv"))
    scored = (found.join(vectors, ["list", "id"]).join(asked, "query_id")
              .select("query_id", F.col("id").alias("doc_id"), (F.lit(1.0) - cosine_distance("qv", "vec")).alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.round("score", TIE_DECIMALS).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --------------------------------------------------------------------------
# settings from measured recall


def tune(index: Ivf, queries: DataFrame, query_id: str, vec_col: str, k: int = 10, target: float = 0.9) -> Ivf:
    """``index`` with the fewest probes and the least depth that reach ``target`` (and a
    quarter of what is left to 1 as margin) on the questions of least hash; stored."""
    spark = queries.sparkSession
    asked = materialize(queries.select(F.col(query_id).alias("query_id"), F.col(vec_col).alias("qv"))
                        .orderBy(F.xxhash64(F.col(query_id).cast("string")), query_id).limit(TUNE_QUESTIONS), "asked")
    stored = index.lists(spark)
    exact = topk_scan(stored, "id", Dense("vec", index.dim), asked, "query_id", Dense("qv", index.dim), k=k)
    exact = materialize(exact.where("value IS NOT NULL").select("query_id", F.col("doc_id").alias("id"))
                        .join(stored.select("id", "list"), "id"), "exact")  # TUNE_QUESTIONS * k rows
    every = replace(index, probes=len(index.centroids))
    order = probed(asked, "query_id", "qv", every)
    turns = np.sort(np.array([r["turn"] + 1 for r in exact.join(order, ["query_id", "list"]).select("turn").collect()]))
    if not len(turns):
        return index
    probes = int(turns[min(len(turns) - 1, int(np.ceil((target + (1 - target) / 2) * len(turns))) - 1)])
    goal, depth, rows = target + (1 - target) / 4, 4 * k, stored.count()
    while True:
        tried = replace(index, probes=probes, depth=depth)
        places = np.sort(np.array([r["place"] for r in candidates(tried, asked, "query_id", "qv")
                                   .join(exact, ["query_id", "id"]).select("place").collect()]))
        need = int(np.ceil(goal * len(turns)))
        if len(places) >= need or depth >= rows:
            depth = int(places[min(len(places), need) - 1]) if len(places) else depth
            break
        depth *= 4
    tuned = replace(index, probes=probes, depth=max(depth, k))
    _save(spark, tuned)
    return tuned
