"""Operator 6: byte-level BPE encoding and decoding with a segment tree.

A text is cut by the vocabulary's pre-token pattern; each match is encoded on
its own. Over the byte positions of a match stands a segment tree whose leaf i
holds the merge rank of the token that starts at i with its right neighbour, and
whose inner nodes hold the minimum, leftmost first. The root names the next
merge. A merge changes three leaves (the pair itself, the swallowed neighbour,
the token on the left), point updates of logarithmic cost, so a match of n
bytes takes O(n log n) and long unbroken texts stay cheap.

The job is narrow: every Spark task encodes its own rows, nothing is shuffled.
The rank table (about 1 MB; a fixed file, not data) goes to the executors as a
broadcast. Matches repeat, so each worker keeps a bounded table of those it has
encoded.

Defined cases: a null text is the empty text; an empty text has no ids; repeated
rows are encoded each; an empty table gives an empty table; further columns of
the input are dropped by ``roundtrip`` (it returns the key, never clashes).
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import documents, short_batches, sliced

#: Entries of each of a worker's two tables of encoded matches.
CACHE_ENTRIES = 120_000
#: Longer matches are not kept.
CACHE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token match, merging by the tree's root until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * size + size  # above every key: rank * size + position
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))   # end[i]: where the token that starts at i ends
    prev = list(range(-1, n - 1))  # prev[i]: start of the token on the left

    while tree[1] < none:
        i = tree[1] % size
        j = end[i]
        stop = end[i] = end[j]
        tree[size + j] = tree[size + i] = none
        low = i
        if stop < n:
            prev[stop] = i
            r = get(piece[i:end[stop]])
            if r is not None:
                tree[size + i] = r * size + i
        if i:
            low = prev[i]
            r = get(piece[low:stop])
            tree[size + low] = none if r is None else r * size + low
        # the three leaves' paths to the root, level by level; they soon meet
        a, b, c = (size + low) >> 1, (size + i) >> 1, (size + j) >> 1
        while c:
            x, y = tree[2 * c], tree[2 * c + 1]
            tree[c] = x if x < y else y
            if b != c:
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
            if a != b:
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x < y else y
            a >>= 1
            b >>= 1
            c >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one Python worker.

    Encoded matches are kept in two tables of at most ``CACHE_ENTRIES``: a full one
    becomes the older one, whose entries that are still met move over again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _miss(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            raw = match.encode()
            ids = encode_piece(raw, self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > CACHE_BYTES:
                return packed
        if len(self.cache) >= CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        self.cache[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        miss, out = self._miss, []
        for m in self.find(text):
            out.append(self.cache.get(m) or miss(m))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        if struct.pack("=I", 1) != struct.pack("<I", 1):
            numbers.byteswap()
        return b"".join(map(self.tokens.__getitem__, numbers))


def roundtrip(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids of each text, and the bytes they decode to.

    ``ids`` is binary: little-endian unsigned 32-bit integers.
    """
    short_batches(df.sparkSession)
    spark = df.sparkSession
    # a worker keeps the value of a broadcast from task to task, and its codec with it
    shipped = spark.sparkContext.broadcast({"ranks": load_ranks(ranks_path)})
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shipped.value
        codec = kept.get("codec") or kept.setdefault("codec", Codec(kept["ranks"], pattern))
        for batch in sliced(batches):
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "key": batch.column("key"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "decoded": pa.array([codec.decode(x) for x in ids], pa.binary())})

    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("key", key)


def public_vocabulary() -> tuple[str, str]:
    """(rank file, pre-token pattern) of the public 50k vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenize(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    path, pattern = public_vocabulary()
    return roundtrip(docs, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir, "doc_id", "text"))
