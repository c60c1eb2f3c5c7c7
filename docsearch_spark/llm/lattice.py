"""Operator 4: document log probability over the lattice of subword segmentations.

Model. A document is a sequence of units, drawn one by one, that ends with an end
unit. Units are the pieces of an existing vocabulary (within a word; the first
piece of a word carries the word mark), its byte pieces for characters that it
lacks, and the whole words and whole lines seen in training. A document's
probability is the sum over all ways to segment it. Words and lines have fixed
edges, so that sum is a product over lines, each a sum of its own unit and the
product over its words; a word's sum comes from a forward recursion in log space.

Learning. The vocabulary's scores give the first weights. Expectation
maximisation over the training words turns them into weights of this corpus:
every distinct word counts with its uses in the whole corpus, in each of the
``ROUNDS`` rounds. Units of whole words and lines are discounted by ``DISCOUNT``,
so that rare words still teach the pieces. Word and line tables stay distributed;
a round hands the weights of the words' own units on in a table and brings one
expected count for each vocabulary piece to the driver.

Scoring. The ``HEAD_WORDS`` most frequent words (a fixed bound) go to every task;
the other words, and the lines by their 64-bit names, meet their tables in
shuffles and come back as sums. Texts are never shuffled.

The base score is the add-one unigram over words, computed along the way.

Defined cases: a null text is empty and scores its end token alone; a very long
word is one long lattice; repeated rows are scored each, and count each in
training; without training rows N is 0 and every count is 0; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import BATCH_BYTES, documents, materialize, most_frequent, short_batches, sliced
from docsearch_spark.llm.words import utf8

MARK = "▁"
DISCOUNT = 0.8
#: Expected uses that every piece starts with.
PIECE_PRIOR = 1e-3
#: Rounds of expectation maximisation, each over all distinct training words.
ROUNDS = 7
#: Words that go to every task, and the least words of a line that is a unit.
HEAD_WORDS = 150_000
LINE_WORDS = 4
LINES = "array<struct<line:bigint,score:double,rare:array<string>>>"
#: Entries of a task's partial counts, and lattice cells worked on at once.
PARTIAL_UNITS = 300_000
CELLS = 1 << 18
#: Words whose lattices are worked on together: those of one length go side by side.
STEP_WORDS = 30_000
LOG10 = math.log(10.0)


def load_pieces(path: str) -> tuple[list[str], list[float], list[int]]:
    """(pieces, log weights, the ids of the 256 byte pieces) of a vocabulary file.

    The file's scores rank its pieces; the first weights follow Zipf's law.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks, by_byte = [], [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(piece[3:5], 16)] = len(pieces)
            pieces.append("")
            ranks.append(model.get_piece_size())
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) \
                and MARK not in piece[1:]:
            pieces.append(piece)
            ranks.append(max(1.0, -model.get_score(i)))
    if -1 in by_byte:  # a vocabulary without byte pieces gets them
        for b in range(256):
            if by_byte[b] < 0:
                by_byte[b] = len(pieces)
                pieces.append("")
                ranks.append(model.get_piece_size())
    weights = 1.0 / (np.array(ranks) + 2.7)
    return pieces, list(np.log(weights / weights.sum())), by_byte


class Lattice:
    """Vectorised lattices of many words over one table of pieces."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    BITS = 20

    def __init__(self, pieces: list[str], log_p: np.ndarray, by_byte: list[int],
                 placed: tuple[np.ndarray, np.ndarray, np.ndarray, int] | None = None):
        """``placed``: the table of another lattice over the same pieces."""
        self.log_p = np.r_[np.asarray(log_p, float), -np.inf]  # the last: no such piece
        self.none = len(pieces)
        self.by_byte = by_byte
        self.longest = max(map(len, pieces), default=1)
        self.slots = np.zeros(1 << self.BITS, np.uint64)
        self.ids = np.full(1 << self.BITS, self.none, np.int32)
        self.probes = 1
        if placed is None:
            self._place(pieces)
            at = np.flatnonzero(self.ids != self.none)
            placed = at, self.slots[at], self.ids[at], self.probes
        self.placed = placed
        at, hashes, ids, self.probes = placed
        self.slots[at], self.ids[at] = hashes, ids
        self.taken = np.zeros(1 << self.BITS, bool)  # small enough for a core's cache
        self.taken[at] = True

    def _place(self, pieces: list[str]) -> None:
        for i, piece in enumerate(pieces):
            if piece:
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for ch in piece:
                        h = h * self.STEP + np.uint64(ord(ch) + 1)
                    at = int((h * self.STEP) >> np.uint64(64 - self.BITS))
                probe = 1
                while self.ids[at] != self.none:
                    at, probe = (at + 1) % (1 << self.BITS), probe + 1
                self.slots[at], self.ids[at] = h, i
                self.probes = max(self.probes, probe)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of the hashes that are pieces, ascending by place. Most are of no piece,
        and most of those meet a free slot at once."""
        at = ((h * self.STEP) >> np.uint64(64 - self.BITS)).astype(np.int64)
        place = np.flatnonzero(self.taken[at])
        at, h = at[place], h[place]
        out = np.where(self.slots[at] == h, self.ids[at], self.none)
        for _ in range(self.probes - 1):
            at = (at + 1) & ((1 << self.BITS) - 1)
            out = np.where((out == self.none) & (self.slots[at] == h), self.ids[at], out)
        real = np.flatnonzero(out != self.none)
        return place[real], out[real]

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, code points) of words of one length, within ``CELLS``."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            n = lengths[order[at]]
            same = np.searchsorted(lengths[order], n, "right")
            stop = min(same, at + max(1, CELLS // (n * min(n, self.longest))))
            rows = order[at:stop]
            text = MARK + MARK.join([words[i] for i in rows])
            yield rows, np.frombuffer(text.encode("utf-32-le", "surrogatepass"),
                                      np.uint32).reshape(len(rows), n)
            at = stop

    def arcs(self, codes: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, dict[int, list[int]]]:
        """Piece ids and log weights of single characters, by start; (rows, ids, log weights) of
        the longer pieces by length and start; byte spellings."""
        rows, n = codes.shape
        longer: list = []
        h = units = codes.T.astype(np.uint64) + np.uint64(1)  # a start's words lie side by side
        first = np.full(n * rows, self.none, np.int32)
        place, ids = self._find(h.ravel())
        first[place] = ids
        first = first.reshape(n, rows)
        for size in range(2, min(n, self.longest) + 1):
            h = h[:n - size + 1] * self.STEP + units[size - 1:]
            place, ids = self._find(h.ravel())
            word, weight = place % rows, self.log_p[ids]
            ends = np.searchsorted(place, np.arange(n - size + 2) * rows).tolist()
            longer.append([(word[x:y], ids[x:y], weight[x:y]) for x, y in zip(ends, ends[1:])])
        single = self.log_p[first]
        spelt: dict[int, list[int]] = {}
        if (lacking := first == self.none).any():
            turned = codes.T
            for c in np.unique(turned[lacking]):
                spelt[int(c)] = [self.by_byte[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")]
                single[turned == c] = self.log_p[spelt[int(c)]].sum()
        return first, longer, single, spelt

    def forward(self, longer: list, single: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of each prefix, by its length."""
        n, rows = single.shape
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            acc = alpha[j - 1] + single[j - 1]
            for size in range(2, min(j, len(longer) + 1) + 1):
                hit, _, weight = longer[size - 2][j - size]
                if len(hit):
                    acc[hit] = np.logaddexp(acc[hit], alpha[j - size][hit] + weight)
            alpha[j] = acc
        return alpha

    def log_sums(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's lattice sum."""
        out = np.zeros(len(words))
        for rows, codes in self.groups(words):
            _, longer, single, _ = self.arcs(codes)
            out[rows] = self.forward(longer, single)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, whole: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """(expected uses of each piece, expected uses of each word as a whole).

        ``whole`` holds the log weight of each word's own unit (-inf: none).
        """
        uses = np.zeros(self.none + 1)
        kept = np.zeros(len(words))
        for rows, codes in self.groups(words):
            first, longer, single, spelt = self.arcs(codes)
            n = codes.shape[1]
            alpha = self.forward(longer, single)
            total = np.logaddexp(alpha[-1], whole[rows])
            kept[rows] = counts[rows] * np.exp(whole[rows] - total)
            beta = np.full_like(alpha, -np.inf)
            beta[n] = np.log(counts[rows]) - total
            for i in range(n - 1, -1, -1):
                acc = single[i] + beta[i + 1]
                g = np.exp(alpha[i] + acc)
                np.add.at(uses, first[i], g)
                if spelt:
                    for k in np.flatnonzero(first[i] == self.none):
                        np.add.at(uses, spelt[int(codes[k, i])], g[k])
                for size in range(2, min(n - i, len(longer) + 1) + 1):
                    hit, ids, weight = longer[size - 2][i]
                    if len(hit):
                        via = weight + beta[i + size][hit]
                        np.add.at(uses, ids, np.exp(alpha[i][hit] + via))
                        acc[hit] = np.logaddexp(acc[hit], via)
                beta[i] = acc
        return uses[:-1], kept




def line_hash(words: list[bytes]) -> int:
    """Signed 64-bit name of a line's words."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def count_units(df: DataFrame, text: str = "text", train: str = "train") -> DataFrame:
    """Partial counts of each task: (word, line, n, c), one of word and line null.

    n counts uses in all rows, c in training rows; lines are counted there only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: Counter = Counter()
        lines: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words, names = list(seen), list(lines)
            rest = [w for w in other if w not in seen]
            c = list(seen.values()) + [0] * len(rest)
            n = [x + other.get(w, 0) for w, x in seen.items()] + [other[w] for w in rest]
            words = pa.array(words + rest, pa.binary()).cast(pa.string())
            out = pa.record_batch({
                "word": pa.concat_arrays([words, pa.nulls(len(names), pa.string())]),
                "line": pa.array([None] * len(words) + names, pa.int64()),
                "n": pa.array(n + [0] * len(names), pa.int64()),
                "c": pa.array(c + list(lines.values()), pa.int64())})
            for held in (seen, other, lines):
                held.clear()
            return out

        for batch in sliced(batches, text):
            for t, use in zip(utf8(batch.column(text)), batch.column(train).to_pylist()):
                t = t.lower()
                if use:
                    split = [x.split() for x in t.split(b"\n")]
                    seen.update(chain.from_iterable(split))
                    lines.update([line_hash(words) for words in split if len(words) >= LINE_WORDS])
                else:
                    other.update(t.split())
                if len(seen) + len(other) + len(lines) >= PARTIAL_UNITS:
                    yield flush()
        if seen or other:
            yield flush()

    return df.select(text, train).mapInArrow(run, "word string, line bigint, n bigint, c bigint")


def whole_logs(uses: np.ndarray, mass: float) -> np.ndarray:
    """Log weights of the words' own units; no uses: no such unit."""
    with np.errstate(divide="ignore"):
        return np.log(uses) - math.log(mass)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words put together to about ``STEP_WORDS`` rows or ``BATCH_BYTES``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STEP_WORDS or sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def learn(words: DataFrame, ends: int, line_mass: float, pieces: list[str],
          log_p: list[float], by_byte: list[int]) -> tuple[np.ndarray, DataFrame, float]:
    """(log weights of the pieces, (word, uses of the whole word), total mass).

    Every round runs over every distinct training word.
    """
    spark = words.sparkSession
    seen = words.where("c > 0")
    tokens = seen.agg(F.sum("c").alias("c")).first()["c"] or 0
    weights, mass = np.array(log_p) + math.log(0.5), float(max(1, tokens + ends))
    placed = Lattice(pieces, weights, by_byte).placed
    # words used once have no unit of their own in any round
    once = seen.where("c = 1").select("word", "c", F.lit(0.0).alias("uses"))
    several = seen.where("c > 1").select("word", "c", ((F.col("c") - DISCOUNT) / 2).alias("uses"))
    for _ in range(ROUNDS):
        shipped = spark.sparkContext.broadcast((pieces, weights, by_byte, placed))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, mass=mass) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shipped.value)
            uses = np.zeros(lattice.none)
            for batch in gathered(batches):
                c = batch.column("c").to_numpy(zero_copy_only=False).astype(float)
                own = whole_logs(batch.column("uses").to_numpy(zero_copy_only=False), mass)
                got, kept = lattice.expected(batch.column("word").to_pylist(), c, own)
                uses += got
                more = pa.array(c > 1)
                word, c = batch.column("word").filter(more), batch.column("c").filter(more)
                yield pa.record_batch({
                    "word": word, "c": c, "piece": pa.nulls(len(word), pa.int32()),
                    "uses": pa.array(np.maximum(0.0, kept - DISCOUNT)).filter(more)})
            used = np.flatnonzero(uses)
            yield pa.record_batch({"word": pa.nulls(len(used), pa.string()), "c": pa.nulls(len(used), pa.int64()),
                                   "piece": pa.array(used.astype(np.int32)), "uses": pa.array(uses[used])})

        counted = materialize(once.unionByName(several).mapInArrow(
            run, "word string, c bigint, piece int, uses double"), "expected")
        uses = np.full(len(pieces), PIECE_PRIOR)  # every piece stays possible
        for r in counted.where("piece IS NOT NULL").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] += r["uses"]
        several = counted.where("piece IS NULL").select("word", "c", "uses")
        mass = float(uses.sum() + (several.agg(F.sum("uses").alias("u")).first()["u"] or 0.0)
                     + line_mass + ends + 1)
        weights = np.log(uses / mass)
    return weights, several.where("uses > 0").select("word", "uses"), mass


def score_documents(df: DataFrame, train: Column, pieces_path: str, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), one row per row."""
    short_batches(df.sparkSession)
    spark = df.sparkSession
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    train.alias("train"))
    kind = src.schema["key"].dataType.simpleString()
    partial = materialize(count_units(src), "partial")
    words = materialize(partial.where("word IS NOT NULL").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    lines = materialize(partial.where("line IS NOT NULL").groupBy("line").agg(
        (F.sum("c") - DISCOUNT).alias("uses")), "lines")
    trained = src.where("train").count()
    sums = words.agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train = (sums["c"] or 0) + trained
    distinct = sums["v"] + (1 if trained else 0)
    pieces, log_p, by_byte = load_pieces(pieces_path)
    line_mass = lines.agg(F.sum("uses").alias("u")).first()["u"] or 0.0
    weights, wholes, mass = learn(words, trained, line_mass, pieces, log_p, by_byte)
    table = words.join(wholes, "word", "left").select("word", "n", "c", F.coalesce("uses", F.lit(0.0)).alias("uses"))
    end = math.log10((trained + 1) / mass)
    shipped = spark.sparkContext.broadcast((pieces, weights, by_byte))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shipped.value)
        for batch in gathered(batches):
            own = whole_logs(batch.column("uses").to_numpy(zero_copy_only=False), mass)
            logs = np.logaddexp(lattice.log_sums(batch.column("word").to_pylist()), own)
            yield pa.record_batch({"word": batch.column("word"), "n": batch.column("n"),
                                   "c": batch.column("c"), "log_p": pa.array(logs / LOG10)})

    scored = materialize(table.mapInArrow(
        weigh, "word string, n bigint, c bigint, log_p double"), "scored")
    head = most_frequent(scored, "n", HEAD_WORDS).collect()
    sent = spark.sparkContext.broadcast(([r["word"].encode() for r in head],
                                         np.array([r["c"] for r in head], np.int64),
                                         np.array([r["log_p"] for r in head], float)))

    def by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, log_p = sent.value
        get = {w: i for i, w in enumerate(names)}.get
        c, log_p, last = np.r_[c, 0], np.r_[log_p, 0.0], len(names)
        known, base = (c > 0).astype(np.int64), np.log10(c + 1)
        for batch in sliced(batches):
            docs = [[x for x in map(bytes.split, t.lower().split(b"\n")) if x]
                    for t in utf8(batch.column("text"))]
            lines = list(chain.from_iterable(docs))
            words = list(chain.from_iterable(lines))
            at = np.fromiter(map(get, words, repeat(last)), np.int64, len(words))
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            line = np.repeat(np.arange(len(lines)), sizes)
            doc = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
            score = np.bincount(line, log_p[at], len(lines)).astype(float)
            rare = np.flatnonzero(at == last)
            n_rare = np.bincount(line[rare], minlength=len(lines))
            long = sizes >= LINE_WORDS
            kept = np.flatnonzero(long | (n_rare > 0))  # the others are done
            loose = np.bincount(doc, np.where(long | (n_rare > 0), 0.0, score), len(docs)).astype(float)
            per_doc = np.bincount(doc[kept], minlength=len(docs))
            # a rare line lists its words; null: none
            starts = np.r_[0, np.cumsum(n_rare[kept])].astype(np.int32)
            parts = pa.StructArray.from_arrays([
                pa.array([line_hash(lines[k]) if long[k] else None for k in kept], pa.int64()),
                pa.array(score[kept]),
                pa.ListArray.from_arrays(pa.array(starts), pa.array([words[i] for i in rare], pa.binary())
                                         .cast(pa.string()))], ["line", "score", "rare"])
            word_doc = doc[line]
            yield pa.record_batch({
                "key": batch.column("key"),
                "n_tokens": pa.array(np.bincount(word_doc, minlength=len(docs)) + 1),
                "n_known": pa.array(np.bincount(word_doc, known[at], len(docs)).astype(np.int64)),
                "base": pa.array(np.bincount(word_doc, base[at], len(docs)).astype(float)),
                "loose": pa.array(loose),
                "lines": pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32)), parts)})

    docs = src.select("key", "text").mapInArrow(
        by_line, f"key {kind}, n_tokens bigint, n_known bigint, base double, loose double, lines {LINES}"
    ).withColumn("row", F.monotonically_increasing_id())
    docs = materialize(docs, "by_line")
    flat = materialize(docs.select("row", F.explode("lines").alias("x")).select("row", "x.*")
                       .withColumn("at", F.monotonically_increasing_id()), "flat")
    met = (flat.where("size(rare) > 0").select("row", "at", F.explode("rare").alias("word"))
           .join(scored.select("word", "c", "log_p"), "word").groupBy("row", "at")
           .agg(F.count(F.when(F.col("c") > 0, 1)).alias("n_known"),
                F.sum(F.log10(F.col("c") + 1)).alias("base"), F.sum("log_p").alias("more")))
    # lines without rare words skip the join by line number
    plain = flat.where("size(rare) = 0").select(
        "row", "line", "score", F.lit(0).cast("bigint").alias("n_known"), F.lit(0.0).alias("base"))
    mixed = (flat.where("size(rare) > 0").join(met, ["row", "at"])
             .select("row", "line", (F.col("score") + F.col("more")).alias("score"), "n_known", "base"))
    every = plain.unionByName(mixed)
    named = every.where("line IS NOT NULL").join(lines, "line", "left")
    own = F.log10(F.col("uses") / F.lit(mass))
    # log10(10^a + 10^b), taken from the larger
    top, low = F.greatest("score", own), F.least("score", own)
    named = named.withColumn("score", F.when(own.isNull(), F.col("score")).otherwise(
        top + F.log1p(F.pow(F.lit(10.0), low - top)) / LOG10))
    parts = (named.select("row", "score", "n_known", "base")
             .unionByName(every.where("line IS NULL").select("row", "score", "n_known", "base"))
             .groupBy("row").agg(F.sum("score").alias("score"), F.sum("n_known").alias("more_known"),
                                 F.sum("base").alias("more_base")))
    floor, end_base = math.log10(n_train + distinct + 1), math.log10(trained + 1)
    zero = F.lit(0.0)
    return (docs.select("row", "key", "n_tokens", "n_known", "base", "loose").join(parts, "row", "left").select(
        F.col("key").alias(key), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if trained else 0)).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + end_base
         - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("loose") + F.coalesce("score", zero) + end).alias("score")))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2


def public_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scores = score_documents(docs, ~held_out(), public_pieces())
    return scores.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
