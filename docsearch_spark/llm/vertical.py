"""Operator 8: n-gram Jaccard join by vertical partitioning.

All shingles stand in one global order, rare before frequent. The order is cut
into fragments, which cut every document's set into segments; the overlap of a
pair is counted fragment by fragment and the partial counts are summed.

1. Equal sets are one class (a 128-bit digest of the set); its smallest document
   stands for it from here on, so copies never meet each other.
2. Global order: a shingle's key is its 63-bit name; the ``FREQUENT`` most
   frequent ones (a fixed bound, by counts gathered in all tasks) have keys above
   all names, in order of frequency. Any total order gives the same result; this
   one keeps common passages out of the prefixes.
3. Two sets of similarity s share a key among the first n - ceil(s n) + 1 of each.
   Those prefixes are the postings, dealt by key.
4. Stars: in each list every document pairs with a few leaders of the list that
   are in another component; pairs that meet often enough are verified, and
   confirmed links grow the components. A round costs a few rows a posting,
   however large a group of near copies is, and joins most of it.
5. Rest: in lists that still hold several components, the rows outside the
   list's largest component are joined with the others. A linked pair has a least
   number of prefix keys in common (its overlap is at most those and the longer
   rest), so of each side's keys the last few need no look, and pairs that meet
   are counted exactly before they are verified. Only pairs of different
   components come out; after this step no link between components is missing.
6. Verification: both documents' segments of one fragment are intersected, and
   the counts summed over the fragments: 100 * overlap >= 80 * union.

Defined cases: null or empty text: no shingles, linked with nothing, its own
component; fewer than five words: one shingle, the whole sequence; repeated rows
and equal texts are one class; a doc_id with several texts is one document, told by
the longest of them (white space aside; ties: the last in order), and all its rows
get its component; an empty table gives an empty table; other columns are ignored. Names are 63 bits of a mixed hash: only a collision inside
one pair could change its counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.components import components
from docsearch_spark.llm.util import SIMILARITY_PERCENT, SPACE_CLASS, documents, materialize, most_frequent
from docsearch_spark.llm.util import short_batches, sized, sliced
from docsearch_spark.llm.words import shingle_sets, utf8

#: Shingles whose place in the order follows their frequency.
FREQUENT = 1 << 17
#: A task reports a shingle that this many of its documents hold ...
LOCAL_COUNT = 2
#: ... among at most this many shingles counted together.
LOCAL_SHINGLES = 1_000_000
TOP = np.uint64(1 << 63)
#: Rounds of stars, and the leaders of a list in each.
ROUNDS, LEADERS = 1, 3
#: How much more than the one before a leader may depart from the order of company.
VARIETY = 0.05
#: Fragments that hold the names; one more holds the frequent shingles.
FRAGMENT_BITS = 2


def prefix_length(n: int, percent: int = SIMILARITY_PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(na: Column, nb: Column, percent: int = SIMILARITY_PERCENT) -> Column:
    """The overlap from which two sets of these sizes link."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def describe(src: DataFrame) -> DataFrame:
    """(doc_id, n, sig, key, seen): a row a document, and rows of locally frequent shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keys, counts = keys[counts >= LOCAL_COUNT], counts[counts >= LOCAL_COUNT]
            none = len(keys)
            return pa.record_batch({"doc_id": pa.nulls(none, pa.int64()), "n": pa.nulls(none, pa.int64()),
                                    "sig": pa.nulls(none, pa.binary()),
                                    "key": pa.array((keys & ~TOP).view(np.int64)),
                                    "seen": pa.array(counts.astype(np.int64))})

        for batch in sliced(batches):
            sets = shingle_sets(utf8(batch.column("text")))
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            void = len(sets)
            yield pa.record_batch({"doc_id": batch.column("doc_id"),
                                   "n": pa.array([len(s) for s in sets], pa.int64()),
                                   "sig": pa.array(sigs, pa.binary()),
                                   "key": pa.nulls(void, pa.int64()), "seen": pa.nulls(void, pa.int64())})
            for s, sig in zip(sets, sigs):
                if len(s) and sig not in seen:  # copies count once in a task
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
            if size >= LOCAL_SHINGLES:
                yield frequent()
                held, size, seen = [], 0, set()
        if held:
            yield frequent()

    return src.mapInArrow(run, "doc_id bigint, n bigint, sig binary, key bigint, seen bigint")


def ordered_sets(texts: list[bytes], frequent: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Each text's shingle keys in the global order."""
    out = []
    for s in shingle_sets(texts):
        keys = s & ~TOP
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
            hit = frequent[at] == keys
            keys = np.where(hit, TOP | rank[at], keys)
        out.append(np.unique(keys))
    return out


def in_company(postings: DataFrame) -> DataFrame:
    """(key, n, doc) of the lists that hold two postings and more.

    Expects rows dealt by key and sorted by key. A list may reach over Arrow
    batches: the last row of one is looked at again with the next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row (key, n, doc), and whether it went out
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "doc")]
            if held is not None:
                cols = [np.r_[x, c] for x, c in zip(held, cols)]
            key = cols[0]
            if not len(key):
                continue
            same = np.r_[False, key[1:] == key[:-1]]
            shared = same | np.r_[same[1:], False]
            out = shared.copy()
            if held is not None and held[3]:
                out[0] = False
            held = (*(c[-1] for c in cols), bool(shared[-1]) and (len(key) > 1 or bool(held and held[3])))
            yield pa.record_batch([pa.array(c[out]) for c in cols], names=["key", "n", "doc"])

    return postings.mapInArrow(run, "key bigint, n bigint, doc bigint")


def rest_length(n: Column) -> Column:
    """Keys of a set behind its prefix: ceil(80 % of n) - 1."""
    return F.floor((F.lit(SIMILARITY_PERCENT) * n + 99) / 100) - 1


def needed(na: str = "na", nb: str = "nb") -> Column:
    """Prefix keys that linked sets of these sizes have in common at least.

    Their overlap is at most the common prefix keys and the longer rest.
    """
    return least_overlap(F.col(na), F.col(nb)) - rest_length(F.greatest(na, nb))


def paired(rows: DataFrame) -> DataFrame:
    """Rows (d1, n1, d2, n2) whose sizes let link, as (a, na, b, nb) with a < b."""
    first = F.col("d1") < F.col("d2")
    fits = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * SIMILARITY_PERCENT
    return rows.where(fits).select(
        F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b"),
        F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("na"),
        F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("nb"))


def stars(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs of each row with ``LEADERS`` others of its list and another component.

    Leaders are the documents with the most company (``pull``), varied by a hash
    of the round: of near copies those with the fewest edits, which link most, and
    the same ones in most of their lists.
    """
    picks = []
    for k in range(LEADERS):
        vary = F.pmod(F.xxhash64("doc", F.lit(turn * LEADERS + k)), F.lit(1000)) / 1000
        order = F.col("pull") * (1 - vary * VARIETY * (turn * LEADERS + k))
        picks += [F.max_by(c, order).alias(f"{c}{k}") for c in ("doc", "n", "held", "component")]
    rows = lists.join(lists.groupBy("key").agg(*picks), "key").select(
        F.col("doc").alias("d1"), F.col("n").alias("n1"), F.col("held").alias("h1"), "component",
        F.explode(F.array(*[
            F.struct(F.col(f"doc{k}").alias("d2"), F.col(f"n{k}").alias("n2"), F.col(f"held{k}").alias("h2"),
                     F.col(f"component{k}").alias("c2")) for k in range(LEADERS)])).alias("x"))
    # who shares fewer keys with all others than a link needs is no partner
    rows = rows.select("d1", "n1", "h1", "component", "x.*").where(
        (F.col("component") != F.col("c2")) & (F.least("h1", "h2") >= needed("n1", "n2")))
    return (paired(rows).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"))
            .where(F.col("c") * 2 >= needed()).drop("c"))


def labelled(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """Postings (key, n, doc, pull, place, held, component) of the lists that hold several components."""
    if label is None:
        return shared.withColumn("component", F.col("doc"))
    posted = materialize(shared.join(sized(label.withColumnRenamed("id", "doc")), "doc", "left").select(
        "key", "n", "doc", "pull", "place", "held", F.coalesce("component", "doc").alias("component")), "posted")
    several = posted.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x <> y").select("key")
    return materialize(posted.join(several, "key"), "open")


def verify(src: DataFrame, pairs: DataFrame, frequent, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Pairs (a, na, b, nb) that link, by partial overlaps of the fragments."""
    wanted = materialize(pairs.select(F.col("a").alias("doc_id"))
                         .unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_sorted, rank = frequent.value
        for batch in sliced(batches):
            doc, fragment, keys = [], [], []
            for d, s in zip(batch.column("doc_id").to_pylist(),
                            ordered_sets(utf8(batch.column("text")), keys_sorted, rank)):
                at = np.r_[0, np.searchsorted(s, [np.uint64(k << (63 - FRAGMENT_BITS)) for k in
                                                  range(1, (1 << FRAGMENT_BITS) + 1)]), len(s)]
                for k in range(len(at) - 1):
                    if at[k] < at[k + 1]:
                        doc.append(d)
                        fragment.append(k)
                        keys.append(s[at[k]:at[k + 1]].view(np.int64))
            yield pa.record_batch({"doc": pa.array(doc, pa.int64()),
                                   "fragment": pa.array(fragment, pa.int32()),
                                   "keys": pa.array(keys, pa.list_(pa.int64()))})

    segments = materialize(src.join(sized(wanted), "doc_id", "left_semi").mapInArrow(
        cut, "doc bigint, fragment int, keys array<bigint>"), "segments")
    left = segments.select(F.col("doc").alias("a"), "fragment", F.col("keys").alias("ka"))
    right = segments.select(F.col("doc").alias("b"), "fragment", F.col("keys").alias("kb"))
    partial = (pairs.join(left, "a").join(right, ["b", "fragment"])
               .select("a", "na", "b", "nb", F.size(F.array_intersect("ka", "kb")).alias("part")))
    summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("overlap"))
    return summed.where(F.lit(100) * F.col("overlap")
                        >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("overlap")))


def one_text(src: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, text) of the ``repeated`` documents, one row each."""
    plain = F.length(F.regexp_replace("text", SPACE_CLASS, ""))
    return src.join(sized(repeated), "doc_id", "left_semi").withColumn(
        "text", F.coalesce("text", F.lit(""))).groupBy("doc_id").agg(
        F.max(F.struct(plain.alias("size"), "text")).alias("x")).select("doc_id", "x.text")


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id), one row per input row; see the module."""
    spark = df.sparkSession
    short_batches(spark)
    src = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    told = materialize(describe(src), "sets")
    sets = told.where("sig IS NOT NULL").select("doc_id", "n", "sig")
    # from here on every document has one row; repeated rows come back at the end
    repeated = materialize(sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m"))
                           .where("m > 1").select("doc_id"), "repeated")
    single = sets
    if repeated.limit(1).count():
        chosen = materialize(one_text(src, repeated), "chosen")
        src = src.join(sized(repeated), "doc_id", "left_anti").unionByName(chosen)
        counted = materialize(describe(chosen).where("sig IS NOT NULL").select("doc_id", "n", "sig"), "counted")
        single = sets.join(sized(repeated), "doc_id", "left_anti").unionByName(counted)
        sets = sets.join(counted.select("doc_id", F.col("sig").alias("own")), "doc_id", "left").select(
            "doc_id", "n", F.coalesce("own", "sig").alias("sig"))
    classes = materialize(single.where("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    common = sorted(((r["seen"], r["key"]) for r in most_frequent(
        told.where("sig IS NULL").groupBy("key").agg(F.sum("seen").alias("seen")), "seen", FREQUENT).collect()),
        reverse=True)
    keys = np.array([key for _, key in common], np.int64).view(np.uint64)
    order = np.argsort(keys)
    # the most frequent has the highest rank
    rank = (np.uint64(len(keys)) - order.astype(np.uint64))
    frequent = spark.sparkContext.broadcast((keys[order], rank))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = ordered_sets(utf8(batch.column("text")), *frequent.value)
            yield pa.record_batch({
                "rep": batch.column("doc_id"),
                "prefix": pa.array([(s[:prefix_length(len(s))] ^ TOP).view(np.int64) if len(s) else None
                                    for s in sets], pa.list_(pa.int64()))})

    reps = classes.select("rep", "n")
    postings = (src.mapInArrow(prefixes, "rep bigint, prefix array<bigint>").dropna(subset=["prefix"])
                .join(sized(reps), "rep").select(F.explode("prefix").alias("key"), "n", F.col("rep").alias("doc"))
                .repartition("key").sortWithinPartitions("key"))
    shared = materialize(in_company(postings), "company")
    # of each document: its prefix keys that others have too, in order, and its company,
    # the mean size of their lists
    sizes = shared.groupBy("key").agg(F.count("*").alias("m"))
    own = materialize(shared.join(sizes, "key").groupBy("doc", "n").agg(
        F.round(F.sum("m") * 16 / F.col("n")).cast("int").alias("pull"), F.sort_array(F.collect_list("key")).alias("keys")), "own")
    shared = materialize(own.select("doc", "n", "pull", F.size("keys").alias("held"),
                                    F.posexplode("keys").alias("place", "key")), "shared")
    links, label, lists = None, None, labelled(shared, None)
    for turn in range(ROUNDS):
        pairs = materialize(stars(lists, turn), "stars")
        found = materialize(verify(src, pairs, frequent).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        label = components(links)
        lists = labelled(shared, label)
        if found.limit(1).count() == 0:
            break
    # what the stars left: the rows outside a list's largest component with all others
    held = lists.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = held.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    some = lists.join(largest, "key")
    minor = some.where("component <> main").select(
        "key", F.col("n").alias("n1"), F.col("held").alias("h1"), F.col("place").alias("p1"),
        F.col("doc").alias("d1"), F.col("component").alias("c1"))
    every = some.select("key", F.col("n").alias("n2"), F.col("held").alias("h2"), F.col("place").alias("p2"),
                        F.col("doc").alias("d2"), F.col("component").alias("c2"),
                        (F.col("component") == F.col("main")).alias("main2"))
    # of the keys that either side has, the last needed() - 1 can be left out: one of
    # the others is common
    early = F.least(F.col("h1") - F.col("p1"), F.col("h2") - F.col("p2")) >= needed("n1", "n2")
    rows = minor.join(every, "key").where(
        (F.col("c1") != F.col("c2")) & (F.col("main2") | (F.col("d1") < F.col("d2"))) & early)
    left = materialize(paired(rows).distinct(), "met")
    keys = [own.select(F.col("doc").alias(x), F.col("keys").alias("k" + x)) for x in ("a", "b")]
    left = materialize(left.join(keys[0], "a").join(keys[1], "b").where(
        F.size(F.array_intersect("ka", "kb")) >= needed()).drop("ka", "kb"), "rest")
    links = links.unionByName(verify(src, left, frequent).select("a", "b"))
    label = components(links)
    by_sig = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        "sig", F.coalesce("component", "rep").alias("component"))
    return sets.join(by_sig, "sig", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir, "doc_id", "text"))
