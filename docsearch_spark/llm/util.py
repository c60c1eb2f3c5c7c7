"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.session import checkpoint_dir

# Fixed values of the contracts: the white space that separates words, the
# words themselves, and the shingle width and similarity of near duplicates.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80

#: Bytes of text that one step of a Python worker holds at a time.
BATCH_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole documents table, narrowed to the wanted columns."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*columns)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks it was running, and
    later jobs read the files with column pruning. Paths are unique per call.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that may go to every task: a few numbers each, so some MB at most.
SMALL_ROWS = 400_000
#: Records of an Arrow batch; texts are long, and the default holds ten times as many.
BATCH_RECORDS = 1000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has at most
    ``rows`` rows; beyond that the planner shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def short_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches, unless the session asks for another size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_RECORDS))


def most_frequent(df: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows with the largest ``count``, ``bound`` at most; ties go or stay together.

    A histogram over eighths of a power of two gives the least count, so no task
    sorts or sends more rows than come out.
    """
    bucket = F.floor(F.log2(F.col(count)) * 8)
    sizes = df.where(F.col(count) > 0).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["b"]):
        held += r["n"]
        if held > bound:
            break
        least = r["b"]
    return df.where((F.col(count) > 0) & (bucket >= least)) if least is not None else df.limit(0)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``text``."""
    for batch in batches:
        start = held = 0
        sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker lives on for later tasks
