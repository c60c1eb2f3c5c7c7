"""Operator 2: quotation linking and reply-ordered conversations.

1. Parse: a line's quote level is the number of ``>`` signs that open it. Lines
   of one level that follow each other are a passage; level 0 is the message's
   own text. A line ``... wrote:`` right above a quote introduces it and belongs
   to it.
2. Units: of own text, the lines, the paragraphs and the whole; of quoted
   passages the same. A unit is normalised (lower case, white space runs to one
   space) and named by a hash.
3. Link: the original of a unit is the first message of its conversation that has
   it as own text. One least turn a unit is taken before the join, so a line that
   everybody writes stays cheap. A passage links to the earlier message that
   most of its characters come from.
4. Reply: a message replies to the message that its level-1 passages link to
   (most characters, then latest); without any, to the message one turn before
   it, if that is there. Deeper levels tell what the quoted message quoted; they
   are linked but do not decide the reply.
5. Order: levels and roots of the reply trees by pointer doubling; messages stand
   by root, level and turn, so each comes after the one it replies to. Positions
   come from one range-partitioned sort over all conversations, so a conversation
   of any length is spread over tasks.

Defined cases: a null or empty text has no own text and no quotes; a message that
is all quote keeps an empty own text; rows that repeat a (conversation, turn)
pool their quotes and stand next to each other; a row without conversation or
turn links with nothing and is its own root; quotes of later or unknown messages
stay unlinked and are removed all the same; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import materialize, short_batches, sliced

QUOTED = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.S)
INTRODUCED = re.compile(r"\bwrote:\s*$")
UNITS = pa.list_(pa.struct([("passage", pa.int32()), ("depth", pa.int32()), ("name", pa.int64()),
                            ("size", pa.int64())]))
PASSAGES = pa.list_(pa.struct([("depth", pa.int32()), ("text", pa.string())]))
PARSED = ("own string, passages array<struct<depth:int,text:string>>, "
          "units array<struct<passage:int,depth:int,name:bigint,size:bigint>>")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, quoted passages as (level, text)) of a message."""
    rows = []
    for line in text.split("\n"):
        m = QUOTED.match(line)
        rows.append((m[1].count(">"), m[2]) if m else (0, line))
    own, passages = [], []
    for k, (depth, line) in enumerate(rows):
        if depth:
            if k and rows[k - 1][0] == depth:
                passages[-1][1].append(line)
            else:
                passages.append((depth, [line]))
        elif not (k + 1 < len(rows) and rows[k + 1][0] and INTRODUCED.search(line)):
            own.append(line)
    return "\n".join(own).strip(), [(d, "\n".join(x)) for d, x in passages]


def units(text: str) -> dict[int, int]:
    """Name -> characters of the distinct normalised lines, paragraphs and whole."""
    found = {}
    for part in [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]:
        plain = " ".join(part.lower().split())
        if plain:
            h = xxhash.xxh3_64_intdigest(plain)
            found[h - (1 << 64) if h >> 63 else h] = len(plain)
    return found


def parsed(messages: DataFrame) -> DataFrame:
    """Adds own, passages and units (passage -1: own text) to messages with ``text``."""
    kept = [c for c in messages.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own, passages, named = [], [], []
            for text in batch.column("text").to_pylist():
                mine, quoted = parse(text or "")
                own.append(mine)
                passages.append([{"depth": d, "text": t} for d, t in quoted])
                named.append([{"passage": k, "depth": d, "name": h, "size": n}
                              for k, (d, t) in enumerate([(0, mine), *quoted], -1)
                              for h, n in units(t).items()])
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(own, pa.string()),
                                   pa.array(passages, PASSAGES), pa.array(named, UNITS)],
                                  names=[*kept, "own", "passages", "units"])

    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in kept)
    return messages.mapInArrow(run, f"{kinds}, {PARSED}")


def link(found: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, depth, source_turn, chars): the source of each linked passage."""
    flat = found.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode("units").alias("x")).select("conv_id", "turn", "x.*")
    quoted = flat.where("passage >= 0")
    # only names that someone quotes are worth a sum
    asked = quoted.select("conv_id", "name").distinct()
    origin = (flat.where("passage < 0").join(asked, ["conv_id", "name"], "left_semi")
              .groupBy("conv_id", "name").agg(F.min("turn").alias("source_turn")))
    votes = (quoted.join(origin, ["conv_id", "name"]).where("source_turn < turn")
             .groupBy("conv_id", "turn", "passage", "depth", "source_turn")
             .agg(F.sum("size").alias("chars")))
    best = F.max(F.struct("chars", "source_turn")).alias("best")
    return votes.groupBy("conv_id", "turn", "passage", "depth").agg(best).select(
        "conv_id", "turn", "passage", "depth", "best.source_turn", "best.chars")


def reply_trees(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, level) for distinct (conv_id, turn, parent_turn).

    Every round an open message takes over what the message it points to points
    to, so the distance doubles; messages that point to their root are settled and
    take no part in later rounds.
    """
    state = materialize(parents.select(
        "conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"),
        F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("bigint").alias("level"),
        F.col("parent_turn").isNull().alias("settled")), "tree")
    done, active = state.where("settled"), state.where("NOT settled")
    while active.limit(1).count():
        over = done.unionByName(active).select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("next"),
            F.col("level").alias("more"), "settled")
        moved = materialize(active.drop("settled").join(over, ["conv_id", "up"]).select(
            "conv_id", "turn", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"),
            "settled"), "tree")
        done, active = done.unionByName(moved.where("settled")), moved.where("NOT settled")
    return done.select("conv_id", "turn", F.col("up").alias("root_turn"), "level")


def numbered(df: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... along ``order`` within each ``within``.

    One range-partitioned sort, written once; a partition's offset is the number
    of rows before it (one row a partition).
    """
    rows = materialize(
        df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
        .withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id()),
        "ranked")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    offsets = df.sparkSession.createDataFrame(offsets, "part int, before bigint")
    placed = rows.join(F.broadcast(offsets), "part").withColumn(
        "place", F.col("before") + F.col("mono").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*within).agg(F.min("place").alias("first"))
    same = [placed[c].eqNullSafe(first[c]) for c in within]
    joined = placed.join(first, same)
    for c in within:
        joined = joined.drop(first[c])
    return joined.withColumn(name, F.col("place") - F.col("first")).drop(
        "part", "mono", "before", "place", "first")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) in reply order, without quotes.

    conv_id, turn, role, position, root_turn, level, parent_turn, n_passages,
    n_linked, max_depth, own_text.
    """
    short_batches(messages.sparkSession)
    src = messages.select("conv_id", "turn", "role", "text")
    found = materialize(parsed(src), "parsed")
    links = materialize(link(found), "links")
    replied = links.where("depth = 1").groupBy("conv_id", "turn", "source_turn").agg(
        F.sum("chars").alias("chars")).groupBy("conv_id", "turn").agg(
        F.max(F.struct("chars", "source_turn")).alias("best")).select(
        "conv_id", "turn", F.col("best.source_turn").alias("quoted_turn"))
    turns = found.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("last_turn"))
    parents = (turns.join(before, ["conv_id", "turn"], "left").join(replied, ["conv_id", "turn"], "left")
               .select("conv_id", "turn", F.coalesce("quoted_turn", "last_turn").alias("parent_turn")))
    parents = materialize(parents, "parents")
    trees = reply_trees(parents)
    linked = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    per_turn = (trees.join(parents, ["conv_id", "turn"]).join(linked, ["conv_id", "turn"], "left"))
    out = found.join(per_turn, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("level", F.lit(0)).cast("bigint").alias("level"), "parent_turn",
        F.size("passages").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["depth"])), F.lit(0)).alias("max_depth"),
        F.col("own").alias("own_text"))
    return numbered(out, ["conv_id"], ["root_turn", "level", "turn", "role", "own_text"], "position")


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))
