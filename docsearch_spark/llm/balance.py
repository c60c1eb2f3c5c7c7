"""Operator 11: mixing sources to target weights by entropy balancing.

Every source gets a token target, and every document a rate (how often the mix
takes it) such that the rates' relative entropy to "once each" is least under the
sources' token constraints and the bound ``MOST`` of a rate. The dual of that
problem is convex with one multiplier a source, and its solution is an exponential
tilt by size: rate = min(MOST, exp(lambda * size / scale)).

1. Sizes: one pass counts words; documents of equal (source, size) have equal rates,
   so (source, size, n) *classes* are all that the iterations read.
2. Targets: weights by the sources' order, shares beyond ``MOST`` times a source
   reshared. The only state is the level (tokens for a unit of weight), exact integers.
3. Newton: every round is one job that sums gradient and curvature of each source's
   dual over its classes (partial sums first, so a hot source is spread) and steps,
   inside a bracket that is known from the start and halved if a step gains little.
   Sums are decimals, so their order and with it reruns cannot change a digit.
4. Rounding: running sums over each source's classes by size give every class a whole
   number of copies within one document of its sum. What is left of a source's target,
   less than its largest document, is given to or taken from the largest classes that
   fit, until none does. Classes deal their copies to their documents, evenly, and the
   odd ones by the order of a hash of doc_id.

Running sums are cut into blocks (of sizes, of rows), so no task sorts a source.

Defined cases: null or empty text and a text of white space have size 0 and are taken
0 words at rate 1; null sources are one source, the last; a source without words has
target 0; repeated rows are further documents; ties in the order of a hash are rows
with one doc_id and size, which are alike; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsearch_spark.llm.util import SPACE_CLASS, documents, materialize

# Fixed values of the contract: weights by source, repeating, and the most that a
# document or a source is taken.
WEIGHTS = (1, 2, 3)
MOST = 3

#: A source is settled when its tokens are this near its target.
TOLERANCE = 1e-9
#: Sizes of a block of a source's classes, and rows of a block of a class's documents.
BLOCK_SIZES, BLOCK_ROWS = 4096, 20_000
#: Fixed-point bits of the rates when they are rounded.
POINT = 20


def sized_rows(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(id, nameless, name, size): a row each; a null source is (true, '')."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CLASS.replace("[", "[^") + "+"))
    return df.select(F.col(key).alias("id"), F.col(source).isNull().alias("nameless"),
                     F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
                     words.cast("bigint").alias("size"))


SOURCE = ["nameless", "name"]


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``nth``, their place by code point, null last.

    A range-partitioned sort is written with each row's partition and place in it; the
    rows before a partition are counted from a row a partition.
    """
    placed = materialize(
        sources.repartitionByRange(*SOURCE).sortWithinPartitions(*SOURCE)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(parts, "part").select(*sources.columns, (F.col("offset") + F.col("place")).alias("nth"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (nameless, name, total, ...) with ``target``: tokens of the mix."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    weighted = materialize(ranked(sources).withColumn("weight", weight.cast("bigint")).drop("nth"), "weighted")

    def exact(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    left, shares = 0, 1  # level = left / shares: nothing is above it yet
    while True:
        above = exact(F.col("weight")) * F.lit(left).cast("decimal(38,0)") > \
            exact(F.col("total")) * F.lit(most * shares).cast("decimal(38,0)")
        sums = weighted.agg(
            F.sum(exact(F.col("total"))).alias("total"),
            F.sum(F.when(above, exact(F.col("total")) * most).otherwise(0)).alias("held"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        level = int((sums["total"] or 0) - (sums["held"] or 0)), int(sums["weight"] or 1)
        if level == (left, shares):
            break
        left, shares = level
    return weighted.withColumn("target", F.when(above, F.col("total").cast("double") * most)
                               .otherwise(F.col("weight") * F.lit(left / shares)))


def multipliers(classes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(nameless, name, lambda, scale) that solve the dual of every source.

    ``classes``: (nameless, name, size, n); ``sources``: with target, total, least
    (smallest size above 0) and mean (tokens' mean size).
    """
    ratio = F.try_divide(F.col("target"), F.col("total").cast("double"))
    end = F.try_divide(F.col("mean"), F.col("least").cast("double"))  # all rates are at or beyond the ratio at log(ratio) * end
    state = sources.where("total > 0").select(
        *SOURCE, "target", F.col("mean").alias("scale"), F.lit(0.0).alias("lambda"),
        F.when(ratio < 1, F.log(ratio) * end).otherwise(0.0).alias("lo"),
        F.when(ratio > 1, F.lit(math.log(most)) * end).otherwise(0.0).alias("hi"),
        F.lit(float("inf")).alias("gap"), F.lit(False).alias("settled"))
    state = materialize(state, "duals")
    tilt = F.exp(F.col("lambda") * F.col("size") / F.col("scale"))
    mass = (F.col("n") * F.col("size")).cast("double")
    while state.where(~F.col("settled")).limit(1).count():
        sums = (classes.where("size > 0").join(state.where(~F.col("settled")), SOURCE)
                .groupBy(*SOURCE).agg(
                    F.sum((mass * F.least(F.lit(float(most)), tilt)).cast("decimal(38,6)")).cast("double")
                    .alias("tokens"),
                    F.sum(F.when(tilt < most, mass * F.col("size") / F.col("scale") * tilt).otherwise(0.0)
                          .cast("decimal(38,6)")).cast("double").alias("slope")))
        off = F.col("tokens") - F.col("target")
        lo = F.when(off < 0, F.col("lambda")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lambda")).otherwise(F.col("hi"))
        step = F.col("lambda") - F.try_divide(off, F.col("slope"))
        mid = (lo + hi) / 2
        good = (F.col("slope") > 0) & (step > lo) & (step < hi) & (F.abs(off) <= F.col("gap") / 2)
        # a bracket without a number inside is settled, too
        done = (F.abs(off) <= F.col("target") * TOLERANCE) | (mid <= lo) | (mid >= hi)
        stepped = state.join(sums, SOURCE, "left").select(
            *SOURCE, "target", "scale",
            F.when(F.col("settled") | done, F.col("lambda")).when(good, step).otherwise(mid).alias("lambda"),
            F.when(F.col("settled"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("settled"), F.col("hi")).otherwise(hi).alias("hi"),
            F.coalesce(F.abs(off), F.col("gap")).alias("gap"), (F.col("settled") | done).alias("settled"))
        state = materialize(stepped, "duals")
    return state.select(*SOURCE, "lambda", "scale")


def running(df: DataFrame, value: Column, name: str, descending: bool = False) -> DataFrame:
    """``df`` (a row for each source and size) with the sum of ``value`` over the source's
    sizes up to and with the row's own. Blocks of sizes first, then the blocks' sums."""
    sign = -1 if descending else 1
    df = df.withColumn("block", F.floor(F.col("size") / BLOCK_SIZES) * sign).withColumn("value", value)
    sums = df.groupBy(*SOURCE, "block").agg(F.sum("value").alias("held"))
    before = Window.partitionBy(*SOURCE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*SOURCE, "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("held"))
    within = Window.partitionBy(*SOURCE, "block").orderBy(F.col("size") * sign).rowsBetween(
        Window.unboundedPreceding, 0)
    return (df.withColumn(name, F.sum("value").over(within)).join(sums, [*SOURCE, "block"])
            .withColumn(name, F.col(name) + F.col("held")).drop("block", "value", "held"))


def class_copies(classes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``classes`` (with rate) and ``copies``, the whole number that each class takes."""
    one = 1 << POINT
    points = F.round(F.col("rate") * F.col("n") * one).cast("bigint")
    whole = classes.withColumn("points", points).withColumn("rest", F.col("points") % one)
    summed = running(whole, F.col("rest"), "sum")
    half = one // 2
    odd = F.floor((F.col("sum") + half) / one) - F.floor((F.col("sum") - F.col("rest") + half) / one)
    copies = F.when(F.col("size") > 0, F.floor(F.col("points") / one) + odd).otherwise(F.col("n"))
    taken = materialize(summed.select(*SOURCE, "size", "n", "rate", copies.cast("bigint").alias("copies")), "copies")
    aim = sources.select(*SOURCE, F.round("target").cast("bigint").alias("aim"))
    while True:
        over = (taken.groupBy(*SOURCE).agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
                .join(aim, SOURCE).select(*SOURCE, (F.col("words") - F.col("aim")).alias("over")))
        # room: how many copies a class can give or take towards its source's target
        able = (taken.join(over.where("over <> 0"), SOURCE)
                .where((F.col("size") > 0) & (F.col("size") <= F.abs("over")))
                .withColumn("room", F.when(F.col("over") > 0, F.col("copies"))
                            .otherwise(F.col("n") * most - F.col("copies"))).where("room > 0"))
        summed = running(able, F.col("room") * F.col("size"), "sum", descending=True)
        before = F.col("sum") - F.col("room") * F.col("size")
        fits = F.least(F.col("room"), F.floor((F.abs("over") - before) / F.col("size")))
        moves = materialize(summed.where(before < F.abs("over")).withColumn("fits", fits).where("fits > 0")
                            .select(*SOURCE, "size", (-F.signum("over") * F.col("fits")).cast("bigint")
                                    .alias("move")), "moves")
        if not moves.limit(1).count():
            return taken
        taken = materialize(taken.join(moves, [*SOURCE, "size"], "left")
                            .withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"),
                            "copies")


def dealt(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with ``rate`` and ``copies``: a class's copies, dealt evenly to its rows;
    the odd ones go to the first by the hash of their id."""
    own = [*SOURCE, "size"]
    joined = rows.join(classes.select(*own, "n", "rate", F.floor(F.col("copies") / F.col("n")).alias("base"),
                                      (F.col("copies") % F.col("n")).alias("odd")), own)
    order = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))
    width = F.ceil(F.col("n") / BLOCK_ROWS)  # blocks of a class
    joined = joined.withColumn("order", order).withColumn("block", F.pmod("order", width))
    counts = joined.where("odd > 0").groupBy(*own, "block").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*own).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*own, "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("held"))
    within = Window.partitionBy(*own, "block").orderBy("order", "id")
    return (joined.withColumn("nth", F.row_number().over(within)).join(counts, [*own, "block"], "left")
            .withColumn("copies", F.col("base") + F.when(F.col("nth") + F.col("held") <= F.col("odd"), 1).otherwise(0))
            .select("id", *own, "rate", "copies"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, size, source_size, target, rate, copies, taken), one row per input row."""
    rows = materialize(sized_rows(df, key, source, text), "rows")
    classes = materialize(rows.groupBy(*SOURCE, "size").agg(F.count("*").alias("n")), "classes")
    words = F.col("n") * F.col("size")
    sources = classes.groupBy(*SOURCE).agg(
        F.sum(words).alias("total"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.sum((words.cast("decimal(38,0)") * F.col("size"))).alias("squares")).select(
        *SOURCE, "total", "least", F.try_divide(F.col("squares").cast("double"), F.col("total").cast("double")).alias("mean"))
    sources = materialize(targets(sources, weights, most), "targets")
    duals = multipliers(classes, sources, most)
    rate = F.least(F.lit(float(most)), F.exp(F.col("lambda") * F.col("size") / F.col("scale")))
    rated = classes.join(duals, SOURCE, "left").select(
        *SOURCE, "size", "n", F.when(F.col("lambda").isNull(), 1.0).otherwise(rate).alias("rate"))
    copies = class_copies(materialize(rated, "rates"), sources, most)
    return (dealt(rows, copies).join(sources.select(*SOURCE, "total", "target"), SOURCE)
            .select(F.col("id").alias(key), "size", F.col("total").alias("source_size"), "target", "rate",
                    F.col("copies").cast("bigint").alias("copies"),
                    (F.col("copies") * F.col("size")).cast("bigint").alias("taken")))


def op11_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")
