"""Running sums and next rows within groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned by
(group, order) into blocks of about ``BLOCK_ROWS`` rows, so a large group spans many
blocks and small ones share one. What a block must know of its neighbours is one row a
(group, block): the sum of all earlier blocks, or the first row of the next one. Such a
row joins its block by a union, not a join back, and an ordinary window over
(group, block) does the rest; a window partition is a part of a block.

Defined cases: null groups are one group, null orders come first; rows with equal
(group, order) stand in one block and are taken in no particular order; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsearch_spark.functions.text import or_empty
from docsearch_spark.session import materialize

#: Rows of a block: what one task orders.
BLOCK_ROWS = 250_000
BLOCK = "__block"
_CARRIED = "__carried"


def blocked(rows: DataFrame, group: str, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` in the order of (group, order), written once with each row's block, so
    that the sums of the blocks and their rows cannot disagree."""
    blocks = max(1, -(-rows.count() // block_rows))
    return materialize(rows.repartitionByRange(blocks, group, order)
                       .withColumn(BLOCK, F.spark_partition_id()), "blocks")


def with_next(rows: DataFrame, group: str, order: str, following: dict[str, str]) -> DataFrame:
    """``rows`` (as ``blocked`` gives them) with columns of the group's next row:
    ``following`` maps new names to columns; null in the last row."""
    columns = sorted(set(following.values()))
    heads = rows.groupBy(group, BLOCK).agg(F.min(F.struct(order, *columns)).alias("head"))
    earlier = F.lag(BLOCK).over(Window.partitionBy(group).orderBy(BLOCK))
    carried = (heads.withColumn("to", earlier).filter(F.col("to").isNotNull())
               .select(group, F.col("to").alias(BLOCK), "head.*", F.lit(True).alias(_CARRIED)))
    w = Window.partitionBy(group, BLOCK).orderBy(_CARRIED, order)
    both = rows.withColumn(_CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return (both.select("*", *[F.lead(c).over(w).alias(name) for name, c in following.items()])
            .filter(~F.col(_CARRIED)).drop(_CARRIED))


def with_sums(rows: DataFrame, group: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (as ``blocked`` gives them) with the sums of whole numbers over the group's
    earlier rows: ``sums`` maps new names to what is summed; 0 in the first row."""
    valued = rows.select("*", *[v.cast("bigint").alias(name) for name, v in sums.items()])
    totals = valued.groupBy(group, BLOCK).agg(*[F.sum(name).alias(name) for name in sums])
    before = Window.partitionBy(group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(BLOCK))
    carried = (totals.select(group, BLOCK, nth.alias("nth"), *[F.sum(name).over(before).alias(name) for name in sums])
               .filter("nth > 1").drop("nth").withColumn(_CARRIED, F.lit(True)))
    w = (Window.partitionBy(group, BLOCK).orderBy(F.col(_CARRIED).desc(), order)
         .rowsBetween(Window.unboundedPreceding, -1))
    both = valued.withColumn(_CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return (both.withColumns({name: F.coalesce(F.sum(name).over(w), F.lit(0)) for name in sums})
            .filter(~F.col(_CARRIED)).drop(_CARRIED))


def chat_positions(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """G9 over conversations of any length: one row a user turn.

    (conv_id, turn, question, answer, is_pair, n_history, history_chars): the turn is a
    pair if an assistant turn follows directly, ``answer`` is that turn's text;
    ``n_history`` pairs with ``history_chars`` characters come before. A turn's history
    is the pairs (``is_pair``) of its conversation whose ``n_history`` is less, so nothing
    quadratic is stored. System turns, and turns without a role, are dropped.
    """
    turns = blocked(conversations.filter(F.col("role") != "system").select("conv_id", "turn", "role", "text"),
                    "conv_id", "turn", block_rows)
    after = with_next(turns, "conv_id", "turn", {"next_role": "role", "next_text": "text"})
    is_pair = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    users = materialize(
        after.filter(F.col("role") == "user")
        .select("conv_id", "turn", F.col("text").alias("question"), is_pair.alias("is_pair"),
                F.when(is_pair, F.col("next_text")).alias("answer"), BLOCK), "turns")
    chars = F.when(F.col("is_pair"), F.length(or_empty("question")) + F.length(or_empty("answer")))
    return with_sums(users, "conv_id", "turn",
                     {"n_history": F.col("is_pair").cast("int"), "history_chars": chars}).drop(BLOCK)


def fragment_offsets(fragments: DataFrame, doc: str, part: str, text: str, sep: str = "\n",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A3 for documents too long for one string: where each fragment begins in the
    assembled text. (doc, part, text, start, n_chars); a missing fragment counts as ''."""
    rows = blocked(fragments.select(doc, part, or_empty(text).alias(text)), doc, part, block_rows)
    return (with_sums(rows, doc, part, {"start": F.length(text) + len(sep)})
            .withColumn("n_chars", F.length(text).cast("bigint")).drop(BLOCK))
