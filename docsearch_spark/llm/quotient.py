"""Operator 3: exact dedup through counting quotient filters.

1. Every row gets a 64-bit fingerprint of its normalised text (white space
   deleted) and the SHA-256 of it; the narrow table is written once.
2. Each task builds counting quotient filters over its own fingerprints. The
   leading bits of a fingerprint are the quotient, the rest is the remainder.
   A block covers a range of quotients and holds a bitmap of occupied quotients,
   a bitmap of run ends, the remainders in sorted order, and one counter for
   each. Copies within a task collapse into one slot, so a hot text costs one
   slot a task, however many rows carry it.
3. The filters of one block merge by sorted remainders. Quotient and remainder
   give the fingerprint back, so nothing is lost: counts just add up.
4. Fingerprints whose merged count is above one route their rows to byte
   verification: rows are grouped by the normalised text itself, with partial
   sums in each task before the shuffle. Rows of a unique fingerprint are done.

The number of blocks follows the row count, so a block's merge stays bounded.

Defined cases: a null text counts as empty; all empty texts are one group; of
rows that tie on code points the smallest doc_id stays; rows are told apart by
doc_id alone, so a row repeated with its doc_id counts as a copy and shares the
decision; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import SPACE_CLASS, documents, materialize

#: Quotients in a block, as a power of two.
BLOCK_BITS = 14
FILTER_SCHEMA = "block bigint, occupied binary, run_ends binary, remainders binary, counts binary"


def normalized(text) -> Column:
    """The text (null: empty) without white space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+", "")


def quotient_bits(rows: int) -> int:
    """Bits of the quotient for about one row a quotient; a block at least."""
    return min(BLOCK_BITS + 40, max(BLOCK_BITS, int(rows).bit_length()))


def pack(prints: np.ndarray, counts: np.ndarray, bits: int) -> dict[str, list]:
    """Filters, one a block, of ascending distinct fingerprints with counts."""
    shift = np.uint64(64 - bits)
    quotient = prints >> shift
    remainder = prints & np.uint64((1 << (64 - bits)) - 1)
    block = quotient >> np.uint64(BLOCK_BITS)
    out: dict[str, list] = {k: [] for k in ("block", "occupied", "run_ends", "remainders", "counts")}
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        q = (quotient[a:b] & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        occupied = np.zeros(1 << BLOCK_BITS, bool)
        occupied[q] = True
        out["block"].append(int(block[a]))
        out["occupied"].append(np.packbits(occupied).tobytes())
        out["run_ends"].append(np.packbits(np.r_[q[1:] != q[:-1], True]).tobytes())
        out["remainders"].append(remainder[a:b].tobytes())
        out["counts"].append(counts[a:b].astype("<i8").tobytes())
    return out


def unpack(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints and their counts of one filter."""
    remainder = np.frombuffer(row["remainders"], "<u8")
    ends = np.unpackbits(np.frombuffer(row["run_ends"], np.uint8))[:len(remainder)].astype(np.int64)
    run = np.cumsum(ends) - ends  # the run that a slot belongs to
    q = np.flatnonzero(np.unpackbits(np.frombuffer(row["occupied"], np.uint8)))[run].astype(np.uint64)
    quotient = (np.uint64(row["block"]) << np.uint64(BLOCK_BITS)) | q
    return (quotient << np.uint64(64 - bits)) | remainder, np.frombuffer(row["counts"], "<i8")


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ascending list of fingerprints; counts of equal ones add up."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prints, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    counts = np.zeros(len(prints), np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in parts]))
    return prints, counts


def build_filters(prints: DataFrame, column: str, bits: int) -> DataFrame:
    """Filters of each task's fingerprints (signed 64-bit), one row a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            p, c = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64),
                             return_counts=True)
            parts.append((p, c))
            held += len(p)
            if held > 4_000_000:  # a very large partition is cut into several filters
                yield pa.record_batch(pack(*merge(parts), bits), schema=arrow)
                parts, held = [], 0
        if parts:
            yield pa.record_batch(pack(*merge(parts), bits), schema=arrow)

    arrow = pa.schema([("block", pa.int64())] + [(k, pa.binary()) for k in
                      ("occupied", "run_ends", "remainders", "counts")])
    return prints.select(column).mapInArrow(run, FILTER_SCHEMA)


def merge_filters(filters: DataFrame, bits: int) -> DataFrame:
    """One filter a block, with the counts of all partitions."""
    def run(table: pa.Table) -> pa.Table:
        merged = pack(*merge([unpack(r, bits) for r in table.to_pylist()]), bits)
        return pa.table(merged, schema=table.schema)

    return filters.groupBy("block").applyInArrow(run, FILTER_SCHEMA)


def repeated(filters: DataFrame, bits: int) -> DataFrame:
    """(fp, n): fingerprints of a merged filter whose count is above one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, c = unpack(row, bits)
                hit = c > 1
                yield pa.record_batch({"fp": pa.array(p[hit].view(np.int64)),
                                       "n": pa.array(c[hit].astype(np.int64))})

    return filters.mapInArrow(run, "fp bigint, n bigint")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per input row."""
    src = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("plain", normalized("text"))
    rows = materialize(src.select("doc_id", F.xxhash64("plain").alias("fp"),
                                  F.sha2("plain", 256).alias("sha")), "fingerprints")
    bits = quotient_bits(rows.count())
    filters = materialize(merge_filters(build_filters(rows, "fp", bits), bits), "filters")
    routed = materialize(repeated(filters, bits), "routed")
    copies = (src.select("doc_id", "plain", F.length("text").alias("points"),
                         F.xxhash64("plain").alias("fp"))
              .join(routed.select("fp"), "fp"))
    # byte verification: the text is the key; a hot one collapses inside each task
    sized = copies.groupBy("plain", "points").agg(F.min("doc_id").alias("doc_id"),
                                                  F.count("*").alias("n"))
    groups = (sized.groupBy("plain")
              .agg(F.min(F.struct(-F.col("points"), "doc_id")).alias("best"),
                   F.sum("n").alias("group_size"))
              .where("group_size > 1")
              .select(F.sha2("plain", 256).alias("sha"), F.col("best.doc_id").alias("keep_id"),
                      "group_size"))
    out = rows.select("doc_id", "sha").join(groups, "sha", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(F.col("doc_id").alias(key), keep.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
  FROM documents),
w AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(plain) AS text_sha256
FROM w
"""
