"""Operator 12: fill-in-middle transformation by secondary sort.

Every text is cut at two unit borders into prefix, middle and suffix, and comes
out as is (plain), or with its parts in another order behind marks (psm, spm).
No task ever holds an assembled output:

1. a map step cuts the parts into pieces of whole units, ``PIECE_BYTES`` at most,
   keyed by document and output position; position -1 is the document's head;
2. ``repartition`` by document and ``sortWithinPartitions`` by document and
   position (the DataFrame form of repartitionAndSortWithinPartitions) bring them
   into output order, and a streaming step feeds them to an incremental digest;
3. the same step reads that output, and nothing else, back: it finds the marks in
   the stream, tells each byte's part by the form, and emits pieces keyed by
   document and position in the original text;
4. a second sort within the partitions puts those in order (a document's pieces are
   all in its partition already, so nothing is shuffled again), and a second digest
   tells the restored text.

A document's key is (doc_id, SHA-256 of its text), not a row number, so a retried
task gives the same pieces. Rows that agree in both are one stream with a count of
``copies``, counted per Arrow batch before the shuffle, and come out as often.

Defined cases: null text is the empty text, whose form is plain, with one empty
output; a null doc_id counts as the empty string in the digest that cuts the text;
a text that holds a mark is plain; an unbroken run of letters is one unit, however
long, and is the only thing that a piece border may cut; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.llm.util import documents, short_batches, sliced

# Fixed values of the contract: marks, output order of the parts of each form
# (0 prefix, 1 middle, 2 suffix), shares of plain and spm in percent, and the salt.
MARKS = (b"<P>", b"<M>", b"<S>")
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN_FROM, SPM_BELOW = 90, 20
SALT = "1:"

#: Bytes of a piece at most.
PIECE_BYTES = 64 << 10
#: Rows of a batch that a streaming step gives out, and bytes that close it early.
OUT_ROWS, OUT_BYTES = 1000, 4 << 20

IDENTITY = "doc_id {kind}, sha binary, copies bigint, at bigint"
HEAD = "n bigint, form string, prefix_chars bigint, middle_chars bigint"
PIECES = f"{IDENTITY}, {HEAD}, piece binary"

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


def unit_starts(raw: bytes) -> np.ndarray:
    """Byte offsets of the units ``[A-Za-z]+|[^A-Za-z]`` of a UTF-8 text."""
    b = np.frombuffer(raw, np.uint8)
    letter = _LETTER[b]
    start = (b & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def code_points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def cut(raw: bytes, starts: np.ndarray, a: int, b: int) -> Iterator[bytes]:
    """raw[a:b] in pieces that end where a unit ends, unless one unit is longer."""
    while b - a > PIECE_BYTES:
        end = int(starts[np.searchsorted(starts, a + PIECE_BYTES, "right") - 1])
        if end <= a:
            end = a + PIECE_BYTES  # inside a run of letters
        yield raw[a:end]
        a = end
    yield raw[a:b]


def pieces_of(raw: bytes, h: list[int]) -> tuple[tuple, Iterator[bytes]]:
    """((n, form, prefix_chars, middle_chars), pieces in output order) of one text."""
    starts = unit_starts(raw)
    n = len(starts)
    if not raw or any(m in raw for m in MARKS) or h[2] % 100 >= PLAIN_FROM:
        return (n, "plain", None, None), cut(raw, starts, 0, len(raw))
    form = "spm" if h[3] % 100 < SPM_BELOW else "psm"
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y = (int(starts[k]) if k < n else len(raw) for k in (first, last))
    borders = (0, x), (x, y), (y, len(raw))

    def stream() -> Iterator[bytes]:
        for part in ORDER[form]:
            for i, piece in enumerate(cut(raw, starts, *borders[part])):
                yield piece if i else MARKS[part] + piece

    return (n, form, code_points(raw[:x]), code_points(raw[x:y])), stream()


class Reader:
    """Tells the part of every byte of an output that comes in pieces."""

    def __init__(self, form: str):
        self.parts = list(ORDER.get(form, ()))
        self.part = 0
        self.held = b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        """(part, bytes) of all that can be told so far; a mark may straddle pieces."""
        data = self.held + piece
        self.held = b""
        while self.parts:
            mark = MARKS[self.parts[0]]
            at = data.find(mark)
            if at < 0:
                keep = len(mark) - 1
                self.held = data[-keep:]
                data = data[:-keep]
                break
            if at:
                yield self.part, data[:at]
            self.part = self.parts.pop(0)
            data = data[at + len(mark):]
        if data:
            yield self.part, data


class Out:
    """Rows of a streaming step, given out in batches of bounded bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> bool:
        self.rows.append(row)
        self.bytes += size
        return len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def arrow_schema(kind: pa.DataType, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("sha", pa.binary()), ("copies", pa.int64()), *fields])


HEAD_FIELDS = (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()))


def output_pieces(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha, copies, at, n, form, prefix_chars, middle_chars, piece).

    Row ``at`` = -1 is a document's head; the pieces of its output follow from 0 on.
    """
    short_batches(df.sparkSession)
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    src = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    digest.alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            count: dict[tuple, int] = {}
            work = []
            for doc, raw, hexed in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(),
                                       batch.column("digest").to_pylist()):
                who = doc, hashlib.sha256(raw).digest()
                if who not in count:
                    work.append((who, raw, [int(hexed[i:i + 8], 16) for i in range(0, 32, 8)]))
                count[who] = count.get(who, 0) + 1
            out = Out(arrow_schema(batch.schema.field("doc_id").type, ("at", pa.int64()), *HEAD_FIELDS,
                                   ("piece", pa.binary())))
            for who, raw, h in work:
                head, stream = pieces_of(raw, h)
                out.add((*who, count[who], -1, *head, None))
                for at, piece in enumerate(stream):
                    if out.add((*who, count[who], at, None, None, None, None, piece), len(piece)):
                        yield out.batch()
            yield out.batch()

    return src.mapInArrow(run, PIECES.format(kind=src.schema["doc_id"].dataType.simpleString()))


def in_order(pieces: DataFrame) -> DataFrame:
    """Each document's pieces in one partition, by position: the secondary sort."""
    return pieces.repartition("doc_id", "sha").sortWithinPartitions("doc_id", "sha", "at")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, tuple, Iterator[bytes]]]:
    """(identity, copies, head, pieces) of one document after the other.

    Rows are read as they come; equal positions are the same piece from rows
    that agree in doc_id and text, whose heads give the number of copies.
    """
    names = "doc_id", "sha", "copies", "at", "n", "form", "prefix_chars", "middle_chars", "piece"
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
    for who, own in groupby(rows, key=lambda r: r[:2]):
        copies = 0
        for row in own:  # heads, then the first piece
            if row[3] >= 0:
                break
            copies += row[2]
            head = row[4:8]

        def body(row=row, own=own):
            last = row[3]
            yield row[8]
            for row in own:
                if row[3] > last:
                    last = row[3]
                    yield row[8]

        yield who, copies, head, body()


def assembled(pieces: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): whole outputs, one row
    for each input row. Only for texts that fit a row; digests need no such thing."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in _peeked(batches):
            out = Out(pa.schema([("doc_id", batch[0]), *HEAD_FIELDS, ("output", pa.binary())]))
            for who, copies, head, body in streams(batch[1]):
                text = b"".join(body)
                for _ in range(copies):
                    if out.add((who[0], *head, text), len(text)):
                        yield out.batch()
            yield out.batch()

    return (in_order(pieces).mapInArrow(run, f"doc_id {kind}, {HEAD}, output binary")
            .withColumn("output", F.decode("output", "UTF-8")))


def _peeked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, Iterator[pa.RecordBatch]]]:
    """(type of doc_id, all batches) once, or nothing if there are none."""
    first = next(batches, None)
    if first is not None:
        def again():
            yield first
            yield from batches
        yield first.schema.field("doc_id").type, again()


def restoring_pieces(pieces: DataFrame) -> DataFrame:
    """The output of every document, read back: pieces by position in the original.

    ``at`` orders prefix, middle and suffix; the last row of a document carries its
    head and the digest of the output that was read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, own in _peeked(batches):
            out = Out(arrow_schema(kind, ("at", pa.int64()), *HEAD_FIELDS, ("piece", pa.binary())))
            for who, copies, head, body in streams(own):
                digest, reader, seq = hashlib.sha256(), Reader(head[1]), 0
                for piece in body:
                    digest.update(piece)
                    for part, data in reader.feed(piece):
                        if out.add((*who, copies, (part << 40) + seq, None, None, None, None, data), len(data)):
                            yield out.batch()
                        seq += 1
                if out.add((*who, copies, 3 << 40, *head, digest.digest())):
                    yield out.batch()
            yield out.batch()

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return in_order(pieces).mapInArrow(run, PIECES.format(kind=kind))


def digests(pieces: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "doc_id", "sha", "copies", "at", "n", "form", "prefix_chars", "middle_chars", "piece"
        for kind, own in _peeked(batches):
            out = Out(pa.schema([("doc_id", kind), *HEAD_FIELDS, ("output_sha256", pa.string()),
                                 ("restored_sha256", pa.string())]))
            rows = (row for batch in own for row in zip(*(batch.column(c).to_pylist() for c in names)))
            for who, mine in groupby(rows, key=lambda r: r[:2]):
                digest = hashlib.sha256()
                for row in mine:
                    if row[3] < 3 << 40:
                        digest.update(row[8])
                        continue
                    for _ in range(row[2]):
                        if out.add((who[0], *row[4:8], row[8].hex(), digest.hexdigest())):
                            yield out.batch()
            yield out.batch()

    kind = pieces.schema["doc_id"].dataType.simpleString()
    # still dealt by document: only sorted again
    return restoring_pieces(pieces).sortWithinPartitions("doc_id", "sha", "at").mapInArrow(
        run, f"doc_id {kind}, {HEAD}, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(output_pieces(documents(spark, sf_dir, "doc_id", "text")))


OP12_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
hashed AS (
  SELECT *, len(u) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
         array_to_string(u[b + 1:], '') AS s
  FROM cuts)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
