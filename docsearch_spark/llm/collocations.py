"""Operator 13: phrase collocations by sorted count streams.

1. One stream of windows. Every word starts a window of up to ``LONGEST`` words of its
   piece. Sorted as strings whose words each end in a space, windows have all their
   prefixes as runs, so one sorted stream holds the counts of all phrases: a stack of
   open runs, no hash table. Only a partition's first and last runs can go on in
   another one, and they are the only counts that are summed afterwards.
2. Prefix order. The stream of counted phrases, sorted, has a phrase's first words
   right above it: the stack of open phrases gives the counts of all left parts, and
   a phrase that closes knows its most frequent extension to the right.
3. Suffix order. The same rows, sorted by their words backwards, meet their right
   parts and their extensions to the left in the same way. Left, right and extension
   counts come out of the two lockstep passes; nothing is joined by hash.

A window need not reach over a pair of words that occurs fewer than ``least`` times.
Pairs and words fall into 65,536 * k buckets by a hash; a bucket's sum below ``least``
proves that all its members are rarer. The bitmap of the other buckets is the only
thing broadcast: at most ``MOST_BUCKETS`` bits, whatever the input. It saves sorting;
counts and results do not depend on it.

Windows are counted per few MB of text before they are written, so a window that a
third of all texts repeat is a row a batch. Windows are dealt by range of the whole
window: a hot first word is spread. The two passes deal by first (last) word and hold
a path of ``LONGEST`` phrases, however many share it.

Defined cases: null text is empty and has no words; a null lang is ``und``; repeated
rows count each; ties end at the phrase in byte order, so rows never tie; an empty
table gives an empty table; other columns are ignored. Cutting scores are Python
integers, exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsearch_spark.llm.util import documents, materialize, short_batches
from docsearch_spark.llm.words import STEP, mix

# Fixed values of the contract: what ends a piece, what parts words, the language of
# null, phrase lengths, least count, score factor, percent of the drop rule, rows a language.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
UNKNOWN = "und"
LONGEST = 4
LEAST = 30
FACTOR = 2_000_000
DROP_PERCENT = 80
TOP = 2000

#: Bytes of text whose windows are counted together.
SLICE_BYTES = 8 << 20
#: Bucket numbers are dealt to tasks by their upper bits; a task counts this many at a time.
PART_BUCKETS = 1 << 16
LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 28
#: Text bytes for a bucket.
BYTES_A_BUCKET = 24
#: Rows of a batch that a streaming step gives out.
OUT_ROWS = 20_000

_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 break
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """(texts, langs) of about ``SLICE_BYTES`` each."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for t, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()):
            texts.append(t)
            langs.append(lang)
            held += len(t)
            if held >= SLICE_BYTES:
                yield texts, langs
                texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


class Words:
    """The words of a slice: ``flat`` holds them lower-cased, each with one space behind.

    ``at``: where word i starts in ``flat``; ``code``: its number in ``names``;
    ``lang``: its language's number; ``linked``: word i + 1 is in the same piece.
    """

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = b"\n".join(texts).lower() + b"\n"  # a break parts the texts; lower() knows A-Z only
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        word = kind == 0
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        n = len(starts)
        self.linked = np.r_[piece[1:] == piece[:-1], False] if n else np.zeros(0, bool)
        word[ends] = True  # the first byte behind each word stays, as its space
        flat = data.copy()
        flat[ends] = 32
        self.flat = flat[word]
        size = ends - starts + 1
        self.at = np.r_[0, np.cumsum(size)]
        coded = strings(self.flat, self.at).dictionary_encode()
        # numbers by the words' order, so that windows come out sorted and compress well
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code = place[coded.indices.to_numpy()]
        every = coded.dictionary.take(pa.array(order)).to_pylist()
        self.name = np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every))
        self.langs, number = np.unique(np.array(langs, object), return_inverse=True)
        borders = np.cumsum([len(t) + 1 for t in texts])
        self.lang = number[np.searchsorted(borders, starts, "right")]

    def buckets(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word, and of each word with the one behind it (0 where there is none)."""
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs], np.uint64)
        h = mix(self.name[self.code] ^ (salt[self.lang] if len(salt) else np.zeros(0, np.uint64)))
        pair = np.zeros(len(h), np.uint64)
        pair[:-1] = mix(h[:-1] * STEP + h[1:])
        mask = np.uint64(count - 1)
        return (h & mask).astype(np.int64), np.where(self.linked, pair & mask, 0).astype(np.int64)

    def windows(self, bits: np.ndarray) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        """(lang, windows, counts): windows of words whose buckets are full enough."""
        one, two = self.buckets(len(bits) * 8)

        def full(x: np.ndarray) -> np.ndarray:
            return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1

        open_ = full(one)
        link = self.linked & open_ & full(two)
        long = open_.astype(np.int64)
        reach = link
        for k in range(1, LONGEST):
            long += reach
            reach = reach & np.r_[link[k:], np.zeros(min(k, len(link)), bool)]
        # windows as numbers: the codes of the first two words, then of the next two
        code = np.r_[self.code.astype(np.int64) + 1, np.zeros(LONGEST, np.int64)]
        for number, lang in enumerate(self.langs):
            mine = np.flatnonzero((long > 0) & (self.lang == number))
            words = [np.where(long[mine] > k, code[mine + k], 0) for k in range(LONGEST)]
            halves = [np.unique((words[k] << 32) | words[k + 1], return_inverse=True)[1] for k in (0, 2)]
            _, first, counts = np.unique((halves[0] << 32) | halves[1], return_index=True, return_counts=True)
            at = mine[first]
            yield lang, gathered(self.flat, self.at[at], self.at[at + long[at]]), counts
            total = int(np.count_nonzero(self.lang == number))
            yield lang, pa.array([""]), np.array([total])


def strings(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def gathered(flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The strings flat[a:b] of each row."""
    size = b - a
    offsets = np.r_[0, np.cumsum(size)]
    index = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)
    return strings(flat[index], offsets)


def full_buckets(src: DataFrame, count: int, least: int) -> np.ndarray:
    """Bitmap of the ``count`` buckets whose words and pairs occur ``least`` times or more."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in slices(batches):
            words = Words(texts, langs)
            one, two = words.buckets(count)
            values, times = np.unique(np.r_[one, two[words.linked]], return_counts=True)
            values = np.repeat(values, np.minimum(times, least))
            part = values // PART_BUCKETS
            borders = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            # steps between sorted numbers, upper bytes first: most are zero, and shrink
            low = [np.diff(x, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T[::-1].tobytes()
                   for x in np.split(values % PART_BUCKETS, borders[1:])][:len(borders)]
            yield pa.record_batch({
                "part": pa.array(part[borders], pa.int32()),
                "low": pa.array(low, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(PART_BUCKETS, np.int64)

        def close() -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([now], pa.int32()),
                                    "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])})

        for batch in batches:
            for part, low in zip(batch.column("part").to_pylist(), batch.column("low").to_pylist()):
                if part != now:
                    if now is not None:
                        yield close()
                    now, sums = part, np.zeros(PART_BUCKETS, np.int64)
                steps = np.frombuffer(low, np.uint8).reshape(2, -1).astype(np.int64)
                sums += np.bincount(np.cumsum(steps[0] * 256 + steps[1]), minlength=PART_BUCKETS)
        if now is not None:
            yield close()

    dealt = src.mapInArrow(deal, "part int, low binary")
    rows = (dealt.repartition("part").sortWithinPartitions("part")
            .mapInArrow(add, "part int, bits binary").toLocalIterator())  # count / 8 bytes in all
    bits = np.zeros(count // 8, np.uint8)
    width = PART_BUCKETS // 8
    for r in rows:
        bits[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return bits


def window_stream(src: DataFrame, least: int) -> DataFrame:
    """(lang, words, n): counted windows, each word with a space behind it; the empty
    window counts a language's words."""
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BYTES_A_BUCKET).bit_length()))
    shipped = src.sparkSession.sparkContext.broadcast(full_buckets(src, count, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in slices(batches):
            for lang, windows, counts in Words(texts, langs).windows(shipped.value):
                for i in range(0, len(counts), OUT_ROWS):
                    part = windows.slice(i, OUT_ROWS)
                    yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "words": part,
                                           "n": pa.array(counts[i:i + OUT_ROWS], pa.int64())})

    return src.mapInArrow(run, "lang string, words string, n bigint")


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def count_runs(rows: Iterator[tuple[str, str, int]], least: int) -> Iterator[tuple[str, str, int]]:
    """(lang, phrase, count) from sorted windows: all that reach ``least``, and the runs
    that may go on in a partition before or after, whatever their count."""
    path: list[list] = []  # [word, phrase, count, touches the partition's start]
    now, first = None, True

    def close(depth: int, end: bool = False) -> Iterator[tuple[str, str, int]]:
        while len(path) > depth:
            word, phrase, count, edge = path.pop()
            if path:
                path[-1][2] += count
            if end or edge or count >= least:
                yield now, phrase, count

    for lang, words, n in rows:
        if lang != now:
            yield from close(0)
            now = lang
        if not words:
            yield lang, "", n
            continue
        split = words[:-1].split(" ")
        depth = 0
        while depth < len(path) and depth < len(split) and path[depth][0] == split[depth]:
            depth += 1
        yield from close(depth)
        for word in split[depth:]:
            path.append([word, (path[-1][1] if path else "") + word + " ", 0, first])
        first = False
        path[-1][2] += n
    yield from close(0, True)


def phrases(windows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of up to ``LONGEST`` words that occur ``least``
    times; the empty phrase has the number of words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(count_runs(rows_of(batches, "lang", "words", "n"), least), schema)

    runs = (windows.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
            .mapInArrow(run, "lang string, phrase string, f bigint"))
    return runs.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def paths(rows: Iterator[tuple], key: int, ext: int) -> Iterator[tuple[tuple, list[int], int]]:
    """(row, counts of its ancestors from the shortest, largest extension) of sorted rows.

    A row's ancestors are the rows whose key is a shorter run of its first words.
    ``row[0]`` is the language, ``row[2]`` the count; ``ext`` is the place of an
    extension that is already known, or -1.
    """
    path: list[list] = []  # [row, key, largest extension]

    def close(depth: int) -> Iterator[tuple[tuple, list[int], int]]:
        while len(path) > depth:
            row, _, most = path.pop()
            yield row, [p[0][2] for p in path], most
            if path:
                path[-1][2] = max(path[-1][2], row[2])

    for row in rows:
        depth = len(path)
        while depth and not (path[depth - 1][0][0] == row[0] and row[key].startswith(path[depth - 1][1])):
            depth -= 1
        yield from close(depth)
        path.append([row, row[key], row[ext] if ext >= 0 else 0])
    yield from close(0)


def lowest_cut(a: int, lefts: list[int], rights: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut; ties go to the first. ``rights`` goes
    from the shortest right part to the longest."""
    return min(((FACTOR * a // (left + right), left, right) for left, right in zip(lefts, reversed(rights))),
               key=lambda c: c[0])


def candidates(counted: DataFrame, drop_percent: int = DROP_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that stay."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64()),
                            ("lefts", pa.list_(pa.int64())), ("ext", pa.int64()), ("back", pa.string())])
        found = paths(rows_of(batches, "lang", "phrase", "f"), 1, -1)
        return in_batches(((*row, lefts, ext, " ".join(reversed(row[1][:-1].split(" "))) + " ")
                           for row, lefts, ext in found), schema)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()),
                            ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])

        def rated() -> Iterator[tuple]:
            names = "lang", "phrase", "f", "lefts", "ext", "back"
            for (lang, phrase, a, lefts, _, _), rights, ext in paths(rows_of(batches, *names), 5, 4):
                if lefts and 100 * ext < drop_percent * a:
                    score, left, right = lowest_cut(a, lefts, rights)
                    yield lang, phrase[:-1], a, left, right, score

        return in_batches(rated(), schema)

    first = F.substring_index("phrase", " ", 1)
    last = F.substring_index("back", " ", 1)
    forward = (counted.where("phrase <> ''").repartitionByRange("lang", first).sortWithinPartitions("lang", "phrase")
               .mapInArrow(prefixes, "lang string, phrase string, f bigint, lefts array<bigint>, ext bigint, "
                                     "back string"))
    return (forward.repartitionByRange("lang", last).sortWithinPartitions("lang", "back")
            .mapInArrow(suffixes, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"))


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST,
                 top: int = TOP, drop_percent: int = DROP_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    short_batches(df.sparkSession)
    src = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                    F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''")
    windows = materialize(window_stream(src, least), "windows", "zstd")
    counted = materialize(phrases(windows, least), "phrases")
    found = materialize(candidates(counted, drop_percent), "candidates")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranks.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "lang", "text"))


OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
spots AS (
  SELECT lang, id, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM split),
following AS (
  SELECT lang, w1, lead(w1, 1) OVER ahead AS w2, lead(w1, 2) OVER ahead AS w3, lead(w1, 3) OVER ahead AS w4
  FROM spots WINDOW ahead AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, [w1] AS p, count(*) AS f FROM following GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM following WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM following WHERE w3 IS NOT NULL
    GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM following WHERE w4 IS NOT NULL
    GROUP BY ALL HAVING count(*) >= 30),
words AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
parts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM grams WHERE len(p) > 1),
cuts AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM (SELECT *, p[1:k] AS head, p[k + 1:] AS tail FROM parts) AS c
  JOIN grams AS x ON x.lang = c.lang AND x.p = c.head
  JOIN grams AS y ON y.lang = c.lang AND y.p = c.tail),
best AS (
  SELECT lang, p, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, p[2:] AS p, f FROM grams WHERE len(p) > 2
  UNION ALL SELECT lang, p[:len(p) - 1], f FROM grams WHERE len(p) > 2
  UNION ALL SELECT lang, p[2:3], f FROM grams WHERE len(p) = 4
  UNION ALL SELECT lang, p[1:2], f FROM grams WHERE len(p) = 4
  UNION ALL SELECT lang, p[3:4], f FROM grams WHERE len(p) = 4),
longer AS (SELECT lang, p, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.p = b.p
  WHERE g.f IS NULL OR 100 * g.f < 80 * b.a),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""
