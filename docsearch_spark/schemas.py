"""Table contracts of the engine (explicit StructTypes, never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the application being re-built.
DEFAULT_CHUNK_SIZE = 1200
DEFAULT_CHUNK_OVERLAP = 200
LEGACY_CHUNK_SIZE = 500
LEGACY_CHUNK_OVERLAP = 50
EMBED_BATCH = 64
EMBED_DIM = 1536
TOP_K_DEFAULT = 5
TOP_K_MIN = 1
TOP_K_MAX = 50
K_VALUES = (1, 3, 5, 10)
NORM_EPS = 1e-12
ALLOWED_DATASETS = ("scifact", "fiqa")

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("source_path", T.StringType(), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("content", T.StringType(), False),
])

INDEX = T.StructType(CHUNKS.fields + [
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("bucket", T.IntegerType(), False),
])

CORPUS = T.StructType([
    T.StructField("_id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])

QUERIES_JSON = T.StructType([
    T.StructField("_id", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])

QRELS_TSV = T.StructType([
    T.StructField("query-id", T.StringType(), True),
    T.StructField("corpus-id", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
])

REPORT = T.StructType([
    T.StructField("dataset", T.StringType(), True),
    T.StructField("recall_at_k", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("ndcg_at_k", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("map_at_k", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("precision_at_k", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("mrr", T.DoubleType(), True),
    T.StructField("num_queries", T.IntegerType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType()), True),
])
