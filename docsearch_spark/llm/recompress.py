"""Operator 9: substring dedup by recompression.

Every text is a sequence of words. Recompression rewrites it in rounds: runs of
one symbol become one symbol, then pairs whose left symbol falls on the left
side and whose right one on the right side of a two-way split of all symbols
become one symbol. Symbol names and sides are hashes of what a symbol stands
for, so all tasks give the same names without a dictionary, and equal substrings
get the same symbols but near their edges. Each symbol keeps its *extent*: the
words that its existence depends on. Texts that agree on an extent have that
symbol there.

1. Exact copies of a text need no search: every word of a longer copy goes.
2. Anchors. A window's anchor is a symbol of the highest level whose extent lies
   in the window, by least hash; only the window's words decide, so equal windows
   have equal anchors. A window without one is its own anchor. An anchor's key is
   a hash of the words of its extent. About one word in five starts an anchor.
3. Spark names the keys that several texts hold (one sum a key); a window whose
   anchor no other text holds is unique, which is nearly all of them.
4. Verification. The remaining windows come out with a 96-bit name of all their
   words; the smallest document of each name is found and joined back, and each
   window of a larger document marks its words.
5. The marks of a row, as intervals, meet its text, which is cut.

Sums are partial before the shuffles, and the smallest documents are a table of their
own, so that the join back reads plain shuffles, which the planner splits where a passage
that a third of all texts hold fills a partition.

A row is told by doc_id and ``tag``: 0 where the doc_id has one text, as all should,
else eight bytes of the text's SHA-256. Rows are judged and cut each on its own text.

Defined cases: null or empty text: no words, nothing removed, digest of the
empty string; fewer words than a window: nothing removed; repeats within one
document do not count; rows with one doc_id are never earlier than each other, whether their
texts are equal or not, and each is cut by the smaller doc_ids alone; a null doc_id is
neither smaller nor larger than any, so such rows stay whole and remove nothing; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import documents, materialize, short_batches, sliced
from docsearch_spark.llm.words import STEP, mix, named, utf8

WINDOW = 13
#: Rounds of runs and pairs; later symbols reach over a window.
ROUNDS = 3
#: Bits of an anchor's key. Two anchors with one key only mean more to verify.
KEY_BITS = 44
#: Intervals that may be sent to every task; more are joined by a shuffle.
SENT_INTERVALS = 1_000_000


class Parse:
    """Rounds of recompression over the words of a batch of texts."""

    def __init__(self, split: list[list[bytes]]):
        self.words = named(split)
        sizes = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.text = np.repeat(np.arange(len(split)), sizes)
        n = len(self.words)
        self.power = np.ones(n + 1, np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        if n:
            self.power[1:] = np.multiply.accumulate(np.full(n, STEP))
            # prefix[i + 1] = prefix[i] * STEP + word, over STEP's inverse to be a running sum
            inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
            back = np.multiply.accumulate(np.full(n, inverse))
            self.prefix[1:] = np.cumsum(self.words * back, dtype=np.uint64) * self.power[1:]

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words a..b of each row."""
        return mix(self.prefix[b] - self.prefix[a] * self.power[b - a] + (b - a).astype(np.uint64))

    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each round, the extents (from, to) of the symbols that it made."""
        words, n = self.words, len(self.words)
        name, s, e = words.copy(), np.arange(n), np.arange(n) + 1
        lo, hi, text = s.copy(), e.copy(), self.text
        out = []
        for k in range(ROUNDS if n else 0):
            # runs; a run is told from its surroundings by the words beside it
            opens = np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])]
            at = np.flatnonzero(opens)
            to = np.r_[at[1:], len(name)] - 1
            size = to - at + 1
            run = size > 1
            name = np.where(run, mix(name[at] * STEP + size.astype(np.uint64)), name[at])
            s, e, lo, hi, text = s[at], e[to], lo[at], hi[to], text[at]
            before, after = np.maximum(s - 1, 0), np.minimum(e, n - 1)
            unsure = words[before] == words[e - 1]
            left = np.where(unsure, np.r_[lo[0] - 1, lo[:-1]], s - 1)
            new_lo = np.minimum(lo, np.minimum(left, s - 1))
            unsure = words[after] == words[s]
            right = np.where(unsure, np.r_[hi[1:], n + 1], e + 1)
            new_hi = np.maximum(hi, np.maximum(right, e + 1))
            lo, hi = new_lo, new_hi
            # pairs: left side, right side, by a bit of the name
            side = mix(name + np.uint64(k + 1)) >> np.uint64(63)
            same = text[1:] == text[:-1]
            pair = np.r_[(side[:-1] == 0) & (side[1:] == 1) & same, False]
            second = np.r_[False, pair[:-1]]
            alone = ~pair & ~second
            # that a symbol stays alone depends on the one neighbour it could join
            lo2 = np.where(alone & (side == 1), np.minimum(lo, np.r_[lo[0] - 1, lo[:-1]]), lo)
            hi2 = np.where(alone & (side == 0), np.maximum(hi, np.r_[hi[1:], n + 1]), hi)
            nxt = np.r_[np.arange(1, len(name)), len(name) - 1]
            name = np.where(pair, mix(name * STEP + mix(name[nxt])), name)
            e = np.where(pair, e[nxt], e)
            hi2 = np.where(pair, hi[nxt], hi2)
            keep = ~second
            s, e, lo, hi, text, name = s[keep], e[keep], lo2[keep], hi2[keep], text[keep], name[keep]
            made = (run | pair)[keep]
            out.append((lo[made], hi[made]))
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(window starts, keys): the key of the anchor of every window."""
        last = self.ends - WINDOW
        n = len(self.words)
        whole = np.zeros(n + 1, np.int64)  # marks of the starts of whole windows
        fits = last >= self.starts
        np.add.at(whole, self.starts[fits], 1)
        np.add.at(whole, last[fits] + 1, -1)
        is_window = np.cumsum(whole[:n]) > 0
        key = np.zeros(n, np.uint64)
        open_ = is_window.copy()
        for lo, hi in reversed(self.levels()):
            ok = (hi - lo <= WINDOW) & (lo >= 0) & (hi <= n)
            lo, hi = lo[ok], hi[ok]
            if not len(lo):
                continue
            h = self.span(lo, hi)
            rank = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            best = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
            first = hi - WINDOW
            for d in range(int((lo - first).max()) + 1):
                t = first + d
                inside = (t <= lo) & (t >= 0)
                np.minimum.at(best, t[inside], rank[inside])
            got = open_ & (best != np.uint64(0xFFFFFFFFFFFFFFFF))
            key[got] = h[(best[got] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            open_ &= ~got
        own = np.flatnonzero(open_)
        key[own] = self.span(own, own + WINDOW)
        at = np.flatnonzero(is_window)
        return at, key[at] >> np.uint64(64 - KEY_BITS)


def split_texts(column: pa.Array) -> list[list[bytes]]:
    return [t.split() for t in utf8(column)]


def anchor_keys(src: DataFrame) -> DataFrame:
    """(doc, tag, keys): the distinct anchor keys of each text that has a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parse = Parse(split_texts(batch.column("text")))
            at, key = parse.anchors()
            text = parse.text[at]
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            first = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else []
            text, key = text[first], key[first]
            ids = np.unique(text)
            offsets = np.r_[np.searchsorted(text, ids), len(text)].astype(np.int32)
            yield pa.record_batch({
                "doc": batch.column("doc_id").take(pa.array(ids)),
                "tag": batch.column("tag").take(pa.array(ids)),
                "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))})

    return src.select("doc_id", "tag", "text").mapInArrow(run, "doc bigint, tag bigint, keys array<bigint>")


def candidate_windows(src: DataFrame) -> DataFrame:
    """(name, check, doc, tag, at) of the windows whose anchor key is in ``keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parse = Parse(split_texts(batch.column("text")))
            at, key = parse.anchors()
            text = parse.text[at]
            lists = batch.column("keys")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), [len(x) if x is not None else 0 for x in
                                                          lists.to_pylist()])
            # a key and its text as one number, to look up all at once
            wanted = np.unique(mix(flat.view(np.uint64) + mix(owner.astype(np.uint64) + np.uint64(1))))
            mine = mix(key + mix(text.astype(np.uint64) + np.uint64(1)))
            hit = np.zeros(0, np.int64)
            if len(wanted):
                spot = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                hit = np.flatnonzero(wanted[spot] == mine)
            at, text = at[hit], text[hit]
            name = parse.span(at, at + WINDOW)
            check = np.zeros(len(at), np.uint64)
            for k in range(WINDOW):
                check = mix(check ^ parse.words[at + k])
            yield pa.record_batch({
                "name": pa.array(name.view(np.int64)),
                "check": pa.array((check >> np.uint64(33)).astype(np.int32)),
                "doc": batch.column("doc_id").take(pa.array(text)),
                "tag": batch.column("tag").take(pa.array(text)),
                "at": pa.array((at - parse.starts[text]).astype(np.int32))})

    return src.mapInArrow(run, "name bigint, check int, doc bigint, tag bigint, at int")


def intervals(marks: DataFrame) -> DataFrame:
    """(doc, tag, cuts, n): the marked words of each row, as flat from-to pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column("starts"):
                x = np.unique(starts.values.to_numpy())
                gap = np.flatnonzero(x[1:] - x[:-1] > WINDOW)
                a, b = np.r_[x[:1], x[gap + 1]], np.r_[x[gap], x[-1:]] + WINDOW
                out.append(np.stack([a, b], 1).ravel().tolist())
            yield pa.record_batch({"doc": batch.column("doc"), "tag": batch.column("tag"),
                                   "cuts": pa.array(out, pa.list_(pa.int32())),
                                   "n": pa.array([len(x) // 2 for x in out], pa.int64())})

    grouped = marks.groupBy("doc", "tag").agg(F.collect_list("at").alias("starts"))
    return grouped.mapInArrow(run, "doc bigint, tag bigint, cuts array<int>, n bigint")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): ``kept`` holds the words that stay, one space between."""
    short_batches(df.sparkSession)
    every = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digests = materialize(every.where("text <> '' AND doc_id IS NOT NULL").select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    many = materialize(digests.groupBy("doc_id").agg(F.min("sha").alias("x"), F.max("sha").alias("y"))
                       .where("x <> y").select("doc_id", F.lit(True).alias("many")), "many")
    sha = F.unhex(F.sha2("text", 256))

    def tagged(rows: DataFrame, sha: Column) -> DataFrame:
        eight = F.conv(F.hex(F.substring(sha, 1, 8)), 16, -10).cast("bigint")
        return (rows.join(many, "doc_id", "left")
                .withColumn("tag", F.when(F.col("many"), eight).otherwise(F.lit(0))).drop("many"))

    src = tagged(every, sha)
    firsts = digests.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(tagged(digests.join(firsts, "sha").where("doc_id > first"), F.col("sha"))
                         .select("doc_id", "tag").distinct(), "copies")
    own = ["doc_id", "tag"]
    unique = src.where("doc_id IS NOT NULL").join(copies, own, "left_anti")
    told = materialize(anchor_keys(unique), "anchors")
    flat = told.select("doc", "tag", F.explode("keys").alias("key"))
    shared = materialize(flat.groupBy("key").agg(F.min("doc").alias("x"), F.max("doc").alias("y"))
                         .where("x < y").select("key"), "shared")
    wanted = (flat.join(shared, "key").groupBy(F.col("doc").alias("doc_id"), "tag")
              .agg(F.collect_list("key").alias("keys")))
    found = materialize(candidate_windows(unique.join(wanted, own)), "windows", "zstd")
    # written, so that the join below reads two plain shuffles, whose hot partitions can be split
    first = materialize(found.groupBy("name", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                        .where("first < last").drop("last"), "firsts")
    marks = found.join(first, ["name", "check"]).where("doc > first").select("doc", "tag", "at")
    cuts = materialize(intervals(marks), "cuts")
    total = cuts.agg(F.sum("n").alias("n")).first()["n"] or 0
    cuts = cuts.select(F.col("doc").alias("doc_id"), "tag", "cuts")
    joined = (src.join(copies.withColumn("copy", F.lit(True)), own, "left")
              .join(F.broadcast(cuts) if total <= SENT_INTERVALS else cuts, own, "left"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            total, gone, kept = [], [], []
            for words, copy, cut in zip(split_texts(batch.column("text")), batch.column("copy").to_pylist(),
                                        batch.column("cuts").to_pylist()):
                n = len(words)
                if copy:
                    cut = [0, n] if n >= WINDOW else None
                left = words
                if cut:
                    left, at = [], 0
                    for a, b in zip(cut[::2], cut[1::2]):
                        left += words[at:a]
                        at = b
                    left += words[at:]
                total.append(n)
                gone.append(n - len(left))
                kept.append(b" ".join(left))
            yield pa.record_batch({"doc_id": batch.column("doc_id"),
                                   "n_words": pa.array(total, pa.int64()),
                                   "n_removed": pa.array(gone, pa.int64()),
                                   "kept": pa.array(kept, pa.binary())})

    return (joined.select("doc_id", "text", "copy", "cuts")
            .mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")
            .withColumn("kept", F.decode("kept", "UTF-8")).withColumnRenamed("doc_id", key))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
