"""Operator 7: byte-balanced shards by Karmarkar-Karp differencing.

Equal texts form an indivisible group. A partial partition is a vector of shard
totals; at first each group is one, with all its bytes in one shard. The two
partial partitions with the largest spread (largest minus smallest total) are
combined, the larger totals of one on the smaller totals of the other, until one
is left.

The differencing runs in levels, since it is the same step at each: groups
are dealt to buckets of bounded size by the hash of their text, every task
differences one bucket, and the buckets' final vectors (``shards`` numbers for
``BUCKET_GROUPS`` groups) are dealt to buckets of ``BUCKET_VECTORS`` in turn, until
one bucket is left, so no task's work grows with the table. Buckets are balanced
in themselves and cannot make up for one group larger than a shard, so such groups
get a shard each beforehand. Slots come from
row numbers within (shard, block) plus the block's offset, so no shard is sorted
in one task.

Defined cases: a null text has size 1 and groups with the empty text; an empty
table gives an empty table; fewer groups than shards leave shards empty;
repeated rows are rows of their group; ties break by text digest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsearch_spark.llm.util import documents, materialize

SHARDS = 16
#: Groups that one task differences.
BUCKET_GROUPS = 20_000
#: Vectors that one task differences at the levels above.
BUCKET_VECTORS = 4_000
#: Rows of the blocks within which slots are numbered.
BLOCK_ROWS = 20_000


def difference(vectors: Iterable[list[int]], shards: int) -> list[list[int]]:
    """For each vector of totals, the shard that each of its entries goes to."""
    nodes: list[tuple] = []  # totals descending, left, right, order: entry of each total
    heap: list[tuple[int, int]] = []  # minus the spread, node

    def add(totals: list[int], left: int, right: int) -> None:
        order = sorted(range(shards), key=lambda i: -totals[i])
        ranked = [totals[i] for i in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes)))
        nodes.append((ranked, left, right, order))

    for v in vectors:
        add(v, -1, -1)
    n = len(nodes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        add([x + y for x, y in zip(nodes[a][0], reversed(nodes[b][0]))], a, b)
    place: list[list[int]] = [[]] * len(nodes)
    if nodes:
        place[-1] = list(range(shards))
    for k in range(len(nodes) - 1, n - 1, -1):  # from the last union back to the leaves
        _, a, b, order = nodes[k]
        entry = [0] * shards
        for rank, i in enumerate(order):
            entry[i] = place[k][rank]
        place[a], place[b] = entry, entry[::-1]
    out = []
    for k in range(n):
        entry = [0] * shards
        for rank, i in enumerate(nodes[k][3]):
            entry[i] = place[k][rank]
        out.append(entry)
    return out


def balance(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, shard) for groups (key, size): near-equal bytes, groups whole.

    A group at least as large as the mean of the shards left has a shard of its own (at
    most ``shards`` - 1 groups); the others are differenced over the rest.
    """
    rest, n = groups.agg(F.sum("size"), F.count("*")).first()
    alone, free = [], shards
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * free < rest:
            break
        alone.append((r["key"], len(alone)))
        rest, free = rest - r["size"], free - 1
    if not alone:
        return difference_groups(groups, n, shards)
    own = F.broadcast(groups.sparkSession.createDataFrame(alone, "key binary, shard int"))
    others = difference_groups(groups.join(own, "key", "left_anti"), n - len(alone), free)
    return others.select("key", (F.col("shard") + len(alone)).alias("shard")).unionByName(own)


def difference_groups(groups: DataFrame, n: int, shards: int) -> DataFrame:
    """(key, shard) for ``n`` groups (key, size) by differencing alone."""
    buckets = max(1, -(-n // BUCKET_GROUPS))

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending")])
        sizes = table["size"].to_pylist()
        places = difference(([s] + [0] * (shards - 1) for s in sizes), shards)
        return pa.table({"key": table["key"], "bucket": table["bucket"], "size": table["size"],
                         "part": pa.array([p[0] for p in places], pa.int32())})

    parts = materialize(
        groups.select("key", "size", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket").applyInArrow(local, "key binary, bucket bigint, size bigint, part int"),
        "parts")
    # one row a bucket: a BUCKET_GROUPS-th of the groups
    vectors = parts.groupBy(F.col("bucket").alias("unit")).agg(F.array(*[
        F.sum(F.when(F.col("part") == i, F.col("size")).otherwise(0)) for i in range(shards)]).alias("totals"))
    placed = place_vectors(vectors, buckets, shards).select(F.col("unit").alias("bucket"), "place")
    return parts.join(placed, "bucket").select("key", F.col("place")[F.col("part")].alias("shard"))


def place_vectors(vectors: DataFrame, n: int, shards: int) -> DataFrame:
    """(unit, place) for ``n`` vectors (unit, totals): the shard of each entry.

    Level by level, as long as one task could not hold all of them: the vectors are dealt
    to buckets, each bucket is differenced to one vector, and these are the next level's.
    On the way back a level's entries follow those of the level above.
    """
    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        totals = table["totals"].to_pylist()
        places = difference(totals, shards)
        united = [0] * shards
        for vector, place in zip(totals, places):
            for size, i in zip(vector, place):
                united[i] += size
        return pa.table({"unit": table["unit"], "bucket": table["bucket"],
                         "place": pa.array(places, pa.list_(pa.int32())),
                         "totals": pa.array([united] * len(places), pa.list_(pa.int64()))})

    levels = []
    while not levels or n > 1:
        n = max(1, -(-n // BUCKET_VECTORS))
        level = materialize(
            vectors.select("unit", "totals", F.pmod(F.xxhash64("unit"), F.lit(n)).alias("bucket"))
            .groupBy("bucket").applyInArrow(local, "unit bigint, bucket bigint, place array<int>, totals array<bigint>"),
            "level")
        levels.append(level.select("unit", "bucket", "place"))
        vectors = level.groupBy(F.col("bucket").alias("unit")).agg(F.first("totals").alias("totals"))
    placed = levels[-1].select("unit", "place")
    for level in reversed(levels[:-1]):
        above = placed.select(F.col("unit").alias("bucket"), F.col("place").alias("above"))
        placed = level.join(above, "bucket").select(
            "unit", F.transform("place", lambda i: F.col("above")[i]).alias("place"))
    return placed


def shard(df: DataFrame, shards: int = SHARDS, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot), one row per input row."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(df.select(
        F.col(key).alias("id"), (F.octet_length(value) + 1).cast("bigint").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(value, 256)).alias("key")), "rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = materialize(
        rows.join(balance(groups, shards), "key")
        .select("id", "size", "text_crc32", "shard",
                F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")), "dealt")
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("id")
    return (dealt.withColumn("nth", F.row_number().over(within))
            .join(offsets, ["shard", "block"])
            .select(F.col("id").alias(key), "size", "text_crc32", "shard",
                    (F.col("nth") + F.col("offset") - 1).cast("bigint").alias("slot")))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
