"""Passage containment: which documents hold a passage (judgements for E14).

A passage is contained when its normalised text is a substring of the
document's. The words inside a passage (all but its first and last, which may be
parts of longer words in a document) then stand in the document as whole words,
one after the other. So every passage offers one *anchor*, a run of at most
``ANCHOR_WORDS`` of its inner words; tasks hash all runs of the anchors' lengths in their
documents by numpy and look them up in a table of ``BUCKETS`` bits; an equi-join of the hashes
that are left gives the candidates, and ``contains`` decides.

Passages of fewer than three words have no inner word. Their anchor is a run of
``GRAM`` characters, the one of theirs that the fewest documents hold: tasks look the runs of
their documents up in a table of ``BUCKETS`` bits and hand on only those that passages (but for
collisions) have, first counted, then, of the rarest run of each passage, with the documents'
ids; equi-joins by the run itself decide. A passage of at most ``GRAM``
characters is its own anchor and needs no further test. There is no limit to the number
of passages, and nothing is collected but lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.functions.text import normalize_ws, or_empty
from docsearch_spark.operators.chunking import segments
from docsearch_spark.session import materialize

ANCHOR_WORDS = 8
#: Characters of the anchor of a passage of one or two words.
GRAM = 4
#: Buckets of the table of wanted runs of characters, and characters that a task works on at a time.
BUCKETS = 1 << 20
STEP_CHARS = 1 << 20
#: Steps of a text's coarse pieces, from which the runs of characters are cut.
STEP = 16


def _grams(t: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text, cut from short pieces of it."""
    return F.array_distinct(F.flatten(F.transform(segments(t, STEP + n - 1, n - 1), lambda part: F.when(
        F.length(part) >= n, F.transform(F.sequence(F.lit(1), F.length(part) - n + 1),
                                         lambda i: F.substring(part, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")))))


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, the text of each)."""
    strings = [(t or b"").decode("utf-8", "replace") for t in texts]
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return codes, np.repeat(np.arange(len(strings)), [len(x) for x in strings])


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the ``n`` characters from each place on."""
    h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for i in range(n):
        h = (h + codes[i:len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(44)).astype(np.int64)


def _found(codes: np.ndarray, row: np.ndarray, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the distinct wanted runs of ``n`` (``GRAM`` at most) characters in each text."""
    at = np.flatnonzero(wanted[_buckets(codes, n)])
    at = at[row[at] == row[at + n - 1]]
    c = [codes[at + i].astype(np.int64) if i < n else np.zeros(len(at), np.int64) for i in range(GRAM)]
    high, low = (row[at] << 42) + (c[0] << 21) + c[1], (c[2] << 21) + c[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][:len(order)]
    return row[at[order[first]]], at[order[first]]


def _runs_at(codes: np.ndarray, at: np.ndarray, n: int) -> list[str]:
    text = codes[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le")
    return [text[i:i + n] for i in range(0, len(text), n)]


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def word_runs(texts: list[bytes], lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, text, hash) of the runs of ``n`` words in texts whose words have one space between
    them. The hash of a run follows from the prefix sums at its two ends, whatever its length."""
    held = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) for t in texts])
    ends = np.flatnonzero(held == 32)
    starts = np.r_[0, ends[:-1] + 1]
    real = ends > starts  # an empty text has an empty word
    starts, ends = starts[real], ends[real]
    row = np.searchsorted(np.cumsum(size + 1), starts, "right")
    total = np.r_[np.uint64(0), np.cumsum((held.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(held)))]
    back = _powers(_INVERSE, len(held))[starts]
    first = total[starts]
    for n in lengths:
        m = max(0, len(starts) - n + 1)
        own = np.flatnonzero(row[:m] == row[n - 1:])
        yield n, row[own], _mixed((total[ends[own + n - 1]] - first[own]) * back[own])


def _steps(rb: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows of ``STEP_CHARS`` bytes or a row more."""
    texts = [t or b"" for t in rb.column("t").cast(pa.binary()).to_pylist()]
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= STEP_CHARS or i == len(texts) - 1:
            yield start, texts[start:i + 1]
            start, held = i + 1, 0


def run_anchors(runs: DataFrame) -> DataFrame:
    """``runs`` with the hash (anchor) of its text ``t``, a run of ``len`` words."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts, size = rb.column("t").cast(pa.binary()).to_pylist(), rb.column("len").to_numpy()
            anchor = np.zeros(rb.num_rows, np.uint64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                for _, of, h in word_runs([texts[i] for i in at], [int(n)]):
                    anchor[at[of]] = h
            yield pa.RecordBatch.from_arrays(rb.columns + [pa.array(anchor.view(np.int64))],
                                             names=rb.schema.names + ["anchor"])

    return runs.mapInArrow(hashed, T.StructType(runs.schema.fields + [T.StructField("anchor", T.LongType())]))


def offered_anchors(docs: DataFrame, anchors: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, len, anchor): the runs of words that documents (doc_id, t) and ``anchors``
    (anchor) have in common, but for collisions in the table, once a document and batch."""
    top = F.shiftrightunsigned("anchor", 44)
    wanted = np.zeros(BUCKETS, bool)
    wanted[anchors.select(top.alias("bucket")).distinct().toArrow().column("bucket").to_numpy()] = True  # BUCKETS at most
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for rb in batches:
            for start, texts in _steps(rb):
                for n, of, h in word_runs(texts, lengths):
                    at = np.flatnonzero(wanted[(h >> np.uint64(44)).astype(np.int64)])
                    pairs = np.unique(np.stack([of[at], h[at].view(np.int64)], axis=1), axis=0)
                    if len(pairs):
                        yield pa.record_batch({
                            "doc_id": rb.column("doc_id").take(pa.array(pairs[:, 0] + start)),
                            "len": pa.array(np.full(len(pairs), n, np.int32)), "anchor": pa.array(pairs[:, 1])})

    return docs.select("doc_id", "t").mapInArrow(run, T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("len", T.IntegerType()),
        T.StructField("anchor", T.LongType())]))


def wanted_buckets(grams: DataFrame) -> np.ndarray:
    """The table of wanted runs: which of the ``BUCKETS`` hold one of ``grams`` (gram)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            codes, row = _codes(rb.column("gram").cast(pa.binary()).to_pylist())
            size = np.bincount(row, minlength=rb.num_rows)
            start = np.cumsum(size) - size
            for n in range(1, GRAM + 1):
                own = start[size == n]
                if len(own):
                    yield pa.record_batch({"bucket": pa.array(np.unique(_buckets(codes, n)[own]))})

    held = grams.select("gram").mapInArrow(run, "bucket bigint").distinct().toArrow()  # BUCKETS at most
    wanted = np.zeros(BUCKETS, bool)
    wanted[held.column("bucket").to_numpy()] = True
    return wanted


def offered_grams(docs: DataFrame, grams: DataFrame, lengths: list[int], count: bool = False) -> DataFrame:
    """(doc_id, gram): the runs of characters that documents (doc_id, t) have in common with
    ``grams`` (gram), once a document; with ``count``, (gram, n), the documents that hold each.

    A task looks its texts' runs up in :func:`wanted_buckets`, so only wanted runs leave it."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted_buckets(grams))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for rb in batches:
            for start, texts in _steps(rb):
                codes, row = _codes(texts)
                for n in lengths:
                    of, at = _found(codes, row, n, wanted)
                    if not len(at):
                        continue
                    if not count:
                        yield pa.record_batch({"doc_id": rb.column("doc_id").take(pa.array(of + start)),
                                               "gram": pa.array(_runs_at(codes, at, n), pa.string())})
                        continue
                    _, one, times = np.unique(codes[at[:, None] + np.arange(n)], axis=0, return_index=True,
                                              return_counts=True)
                    yield pa.record_batch({"gram": pa.array(_runs_at(codes, at[one], n), pa.string()),
                                           "n": pa.array(times.astype(np.int64))})

    gram = T.StructField("gram", T.StringType())
    if count:
        met = docs.select("t").mapInArrow(run, T.StructType([gram, T.StructField("n", T.LongType())]))
        return met.groupBy("gram").agg(F.sum("n").alias("n")).join(grams.select("gram").distinct(), "gram")
    met = docs.select("doc_id", "t").mapInArrow(run, T.StructType([T.StructField("doc_id", id_type), gram]))
    return met.join(grams.select("gram").distinct(), "gram").select("doc_id", "gram")


def short_matches(docs: DataFrame, short: DataFrame) -> DataFrame:
    """(item_id, doc_id) for passages ``short`` (item_id, p) of any length and number, by
    their rarest run of characters. ``docs`` is (doc_id, t), normalised."""
    texts = materialize(short.select("p").distinct(), "short")
    own = materialize(texts.select("p", F.explode(F.when(F.length("p") <= GRAM, F.array("p")).otherwise(
        _grams(F.col("p"), GRAM))).alias("gram")), "grams")
    lengths = sorted(r["n"] for r in own.select(F.length("gram").alias("n")).distinct().collect())  # GRAM at most
    if not lengths:
        return short.join(docs.select("doc_id").limit(0), F.lit(True)).select("item_id", "doc_id")
    held = offered_grams(docs, own, lengths, count=True)  # a document offers a run once
    anchors = materialize(own.join(held, "gram").groupBy("p").agg(
        F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "gram")).alias("least"))
        .join(own.groupBy("p").agg(F.count(F.lit(1)).alias("all")), "p").where("met = all")  # else in no document
        .select("p", F.col("least.gram").alias("gram")), "anchors")
    found = offered_grams(docs, anchors, lengths).join(anchors, "gram").select("doc_id", "p")
    sure = found.where(F.length("p") <= GRAM)
    tested = (found.where(F.length("p") > GRAM).join(docs, "doc_id").where(F.contains("t", "p")).select("doc_id", "p"))
    return short.join(sure.unionByName(tested), "p").select("item_id", "doc_id")


def passage_matches(documents: DataFrame, doc_id: str, text_col: str, passages: DataFrame,
                    item_id: str, passage_col: str) -> DataFrame:
    """(item_id, doc_id) of every passage contained in a document. Blank passages
    match nothing."""
    pats = (passages.select(F.col(item_id).alias("item_id"), normalize_ws(or_empty(passage_col)).alias("p"))
            .filter(F.length("p") > 0).withColumn("w", F.split("p", " ")))
    n_anchor = F.least(F.size("w") - F.lit(2), F.lit(ANCHOR_WORDS))
    anchored = materialize(run_anchors(pats.filter(F.size("w") >= 3).select(
        "item_id", "p", n_anchor.alias("len"), F.array_join(F.slice("w", F.lit(2), n_anchor), " ").alias("t"))
    ).drop("t"), "anchors")
    lengths = sorted(r["len"] for r in anchored.select("len").distinct().collect())  # ANCHOR_WORDS at most
    raw = documents.select(F.col(doc_id).alias("doc_id"), or_empty(text_col).alias("t"))
    docs = raw.withColumn("t", normalize_ws("t"))
    out = None
    if lengths:
        # stored, so that the planner knows their size before it moves the documents
        found = materialize(offered_anchors(docs, anchored, lengths)
                            .join(anchored.select("item_id", "len", "anchor"), ["len", "anchor"])
                            .select("item_id", "doc_id").distinct(), "found")
        out = (found.join(raw, "doc_id").withColumn("t", normalize_ws("t"))
               .join(anchored.select("item_id", "p"), "item_id")
               .filter(F.contains("t", "p")).select("item_id", "doc_id"))
    short = materialize(pats.filter(F.size("w") < 3).select("item_id", "p"), "short-passages")
    if short.limit(1).count():
        some = short_matches(docs, short)
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = pats.join(docs.limit(0), F.lit(True)).select("item_id", "doc_id")
    return out
