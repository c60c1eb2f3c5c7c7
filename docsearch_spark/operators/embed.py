"""Embedding stage.

Default embedder: hashed bag of words. Spark lowers the texts, numpy cuts and counts the tokens.

* tokens  = letter/digit runs of the lower-cased text
* bucket  = first 32 bits of md5(token) modulo ``dim``
* value   = count of the bucket's tokens, then L2-normalised

The sparse form is kept as two parallel arrays ``sv_idx ARRAY<INT>`` (sorted
buckets) and ``sv_val ARRAY<DOUBLE>`` (weights). The term counts of an Arrow batch
are one sort of (row, bucket), and a word is hashed once, so embedding
a table is a narrow, shuffle-free projection. ``densify`` gives the fixed-width
``ARRAY<FLOAT>`` of the index contract.

External models plug in through :class:`EmbeddingProvider` and
:func:`embed_with_provider` (``mapInArrow``, one provider per task, requests of
at most 64 texts, results put back by position).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.functions.text import TOKEN_PATTERN, or_empty
from docsearch_spark.functions.vectors import l2_normalize
from docsearch_spark.schemas import EMBED_BATCH, EMBED_DIM, NORM_EPS


# --------------------------------------------------------------------------
# native default embedder


#: Texts whose tokens a worker holds at a time.
COUNTED_ROWS = 2048
#: Tokens whose hash a worker keeps; a full table is dropped and filled anew.
KEPT_TOKENS = 1 << 20
_HASHES: dict[str, int] = {}

#: Application id -> :func:`token_edges` of its Java.
_EDGES: dict[str, np.ndarray] = {}
#: ASCII letters and digits stay, all other ASCII characters become a space.
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def token_edges(spark: SparkSession) -> np.ndarray:
    """Code points beyond ASCII at which runs of token characters begin and end, in turn.

    Spark itself tells them, by the pattern that it would cut tokens with, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _EDGES:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        held = spark.range(128, 0x110000, 1, 1).where(
            ~F.col("id").between(0xD800, 0xDFFF)).where(char.rlike(f"^{TOKEN_PATTERN}$")).toArrow()
        ids = held.column("id").to_numpy()
        starts = np.r_[True, np.diff(ids) > 1][:len(ids)]
        ends = np.r_[np.diff(ids) > 1, True][:len(ids)]
        _EDGES[app] = np.stack([ids[starts], ids[ends] + 1], axis=1).ravel()
    return _EDGES[app]


def in_edges(edges: np.ndarray):
    """Which of some code points are token characters."""
    return lambda codes: np.searchsorted(edges, codes, "right") % 2 == 1


def cut_tokens(texts: pa.Array, is_token) -> tuple[np.ndarray, pa.Array]:
    """(text of each token, tokens in order) of lower-cased texts; null has none.

    Works on the UTF-8 bytes: separators become spaces of the same length. ``is_token``
    tells for an array of distinct code points beyond ASCII which belong to tokens."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    low, high = int(ends[0]), int(ends[-1])
    raw = (data.slice(low, high - low).to_pybytes() if high > low else b"").translate(_ASCII)
    held = np.frombuffer(raw, np.uint8)
    lead = np.flatnonzero(held >= 0xC0)
    if len(lead):
        held = held.copy()
        size = 2 + (held[lead] >= 0xE0) + (held[lead] >= 0xF0)
        code = held[lead].astype(np.int64) & (0xFF >> (size + 1))
        for i in range(1, 4):
            more = size > i
            code[more] = (code[more] << 6) | (held[lead[more] + i] & 0x3F)
        kinds, kind = np.unique(code, return_inverse=True)
        other = ~is_token(kinds)[kind]
        for i in range(4):
            held[lead[other & (size > i)] + i] = 32
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - low).astype(np.int32)), pa.py_buffer(held))
    words = pc.ascii_split_whitespace(spaced)
    flat = words.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    real = pc.not_equal(pc.binary_length(flat), 0)  # a text that begins or ends with a separator has empty ones
    return row[real.to_numpy(zero_copy_only=False)], flat.filter(real)


def _token_hashes(words: list[str]) -> np.ndarray:
    """First 32 bits of each word's md5 (:func:`hash_bucket` before the modulo)."""
    if len(_HASHES) > KEPT_TOKENS:
        _HASHES.clear()
    found = list(map(_HASHES.get, words))
    if None in found:
        for i, w in enumerate(words):
            if found[i] is None:
                found[i] = _HASHES[w] = int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[:4], "big")
    return np.array(found, np.int64)


def _buckets(words: pa.Array, dim: int) -> np.ndarray:
    """The bucket of each word. A word is hashed once a batch."""
    flat = words.dictionary_encode()
    hashes = _token_hashes(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
    return (hashes % dim)[flat.indices.to_numpy(zero_copy_only=False)]


def sparse_counts(texts: pa.Array, dim: int, is_token) -> tuple[pa.Array, pa.Array]:
    """(idx, val) list arrays of lower-cased texts: sorted distinct buckets of their tokens and
    the L2-normalised counts."""
    n = len(texts)
    of, words = cut_tokens(texts, is_token)
    key, count = np.unique(of * dim + _buckets(words, dim), return_counts=True)
    row = key // dim
    length = np.sqrt(np.bincount(row, count.astype(np.float64) ** 2, n))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array((key % dim).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(count / length[row], pa.float64())))


def embed_sparse(df: DataFrame, text_col: str, dim: int = EMBED_DIM,
                 idx_col: str = "sv_idx", val_col: str = "sv_val") -> DataFrame:
    """C1 (default provider): L2-normalised hashed term counts, sparse form.

    Spark lowers the texts and tells the token characters (:func:`token_edges`); numpy cuts
    and counts by Arrow batch: still a narrow projection. A text without tokens gets empty
    arrays (a zero vector).
    """
    tmp = "__lower"
    kept = df.drop(idx_col, val_col)
    schema = T.StructType(kept.schema.fields + [
        T.StructField(idx_col, T.ArrayType(T.IntegerType(), False), False),
        T.StructField(val_col, T.ArrayType(T.DoubleType(), False), False)])
    edges = token_edges(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            own = [i for i, name in enumerate(whole.schema.names) if name != tmp]
            for at in range(0, whole.num_rows, COUNTED_ROWS):
                rb = whole.slice(at, COUNTED_ROWS)
                idx, val = sparse_counts(rb.column(tmp), dim, in_edges(edges))
                yield pa.RecordBatch.from_arrays([rb.column(i) for i in own] + [idx, val],
                                                 names=[rb.schema.names[i] for i in own] + [idx_col, val_col])

    return kept.select("*", F.lower(or_empty(text_col)).alias(tmp)).mapInArrow(run, schema)


def densify(idx_col: str = "sv_idx", val_col: str = "sv_val",
            dim: int = EMBED_DIM, dtype: str = "float") -> Column:
    """Sparse (idx, val) arrays to a fixed-width dense array."""
    m = F.map_from_arrays(F.col(idx_col), F.col(val_col))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast(dtype))


def densify_batches(df: DataFrame, idx_col: str = "sv_idx", val_col: str = "sv_val",
                    dim: int = EMBED_DIM, out_col: str = "embedding") -> DataFrame:
    """Sparse (idx, val) to a dense ``ARRAY<FLOAT>`` column, one numpy scatter
    per Arrow batch (the SQL form needs a map lookup per dimension)."""
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType(), False), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = rb.num_rows
            ic, vc = rb.column(idx_col), rb.column(val_col)
            lens = pc.fill_null(pc.list_value_length(ic), 0).to_numpy().astype(np.int64)
            mat = np.zeros((n, dim), dtype=np.float32)
            rows = np.repeat(np.arange(n), lens)
            if rows.size:
                mat[rows, ic.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = \
                    vc.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim, type=pa.int32())
            arr = pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1), type=pa.float32()))
            yield pa.RecordBatch.from_arrays(rb.columns + [arr], names=rb.schema.names + [out_col])

    return df.mapInArrow(run, schema)


def vector_moments(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``df`` with, in place of its vectors, their width, their non-zero elements and the
    sum of their elements times the 1-based position (n_dims, n_set, moment)."""
    rest = [f for f in df.schema.fields if f.name != vec_col]
    schema = T.StructType(rest + [T.StructField("n_dims", T.IntegerType()), T.StructField("n_set", T.IntegerType()),
                                  T.StructField("moment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            vec, n = rb.column(vec_col), rb.num_rows
            lens = pc.fill_null(pc.list_value_length(vec), 0).to_numpy().astype(np.int64)
            x = vec.flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(x)
            ends = np.cumsum(lens)
            row = np.searchsorted(ends, at, "right")
            place = at - (ends - lens)[row] + 1
            yield pa.RecordBatch.from_arrays(
                [rb.column(f.name) for f in rest]
                + [pa.array(lens.astype(np.int32)), pa.array(np.bincount(row, minlength=n).astype(np.int32)),
                   pa.array(np.bincount(row, x[at].astype(np.float64) * place, n).astype(np.float64))],
                names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


# --------------------------------------------------------------------------
# batching plan (C2) and checks


def plan_batches(chunks: DataFrame, doc_col: str = "doc_id",
                 index_col: str = "chunk_index", batch: int = EMBED_BATCH) -> DataFrame:
    """Request number of each chunk when a document's chunks are sent in
    order, at most ``batch`` texts per request.

    ``chunk_index`` is already the 0-based position inside the document, so
    the batch id is plain integer division: no window, no shuffle.
    """
    return (chunks.withColumn("batch_id", F.floor(F.col(index_col) / F.lit(batch)).cast("int"))
            .withColumn("batch_pos", F.pmod(F.col(index_col), F.lit(batch)).cast("int")))


def check_vectors(df: DataFrame, vec_col: str = "embedding", dim: int = EMBED_DIM):
    """Split into (accepted, rejected) by NOT NULL and width ``dim``."""
    v = F.col(vec_col)
    reason = (F.when(v.isNull(), F.lit("null vector"))
              .when(F.size(v) != F.lit(dim),
                    F.format_string("expected %d dimensions, not %d", F.lit(dim), F.size(v)))
              .when(F.exists(v, lambda x: x.isNull()), F.lit("null element")))
    tagged = df.withColumn("reject_reason", reason)
    ok = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.filter(F.col("reject_reason").isNotNull())
    return ok, bad


def normalize_vectors(df: DataFrame, vec_col: str = "embedding", out: str | None = None,
                      eps: float = NORM_EPS) -> DataFrame:
    """``v / (|v| + 1e-12)`` in DOUBLE."""
    return df.withColumn(out or vec_col, l2_normalize(vec_col, eps))


# --------------------------------------------------------------------------
# pluggable providers


class EmbeddingProvider:
    """A batch embedding model: ``embed(texts) -> float matrix (len(texts), dim)``,
    or, for services that answer out of order, ``[(index, vector), ...]`` with the
    position of each text in the request.

    ``identity`` names model and width; corpus and questions must agree on it
    (:func:`same_provider`). Instances are created inside tasks (one per task), never on the driver.
    """

    name = "abstract"
    dim = EMBED_DIM

    def embed(self, texts: list[str]) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError

    @property
    def identity(self) -> str:
        return f"{self.name}:{self.dim}"


def same_provider(corpus: EmbeddingProvider, questions: EmbeddingProvider) -> None:
    """C4: questions must be embedded by the corpus' provider."""
    if corpus.identity != questions.identity:
        raise ValueError(f"questions are embedded by {questions.identity}, the corpus by {corpus.identity}")


def in_request_order(response, n: int, name: str) -> np.ndarray:
    """The vectors of a response, by their index in the request."""
    if isinstance(response, np.ndarray):
        if response.shape[0] != n:
            raise ValueError(f"provider {name} returned {response.shape[0]} vectors for {n} texts")
        return response.astype(np.float32)
    by_index = {int(i): v for i, v in response}
    missing = [i for i in range(n) if i not in by_index]
    if missing or len(by_index) != n or len(response) != n:
        raise ValueError(f"provider {name} returned {len(response)} vectors for {n} texts; "
                         f"missing indexes {missing[:5]}")
    return np.asarray([by_index[i] for i in range(n)], dtype=np.float32).reshape(n, -1)


class HashedBowProvider(EmbeddingProvider):
    """Python twin of the native default embedder (used to test the stage)."""

    name = "hashed-bow"

    def __init__(self, dim: int = EMBED_DIM):
        import regex
        self.dim = dim
        self._char = regex.compile(TOKEN_PATTERN)

    def _is_token(self, codes: np.ndarray) -> np.ndarray:
        return np.array([self._char.fullmatch(chr(c)) is not None for c in codes.tolist()], bool)

    def embed(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        of, words = cut_tokens(pa.array([(t or "").lower() for t in texts], pa.string()), self._is_token)
        out = np.bincount(of * self.dim + _buckets(words, self.dim), minlength=n * self.dim).reshape(n, self.dim)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=np.zeros(out.shape), where=length > 0)


class OutOfOrderProvider(HashedBowProvider):
    """Answers like a service that works on a request's texts side by side: last first."""

    name = "hashed-bow"

    def embed(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        return list(enumerate(super().embed(texts)))[::-1]


def embed_with_provider(df: DataFrame, text_col: str, provider_factory,
                        out_col: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """C1 through an external model: ``mapInArrow`` over the table.

    Each task builds one provider, cuts its rows into requests of at most
    ``batch`` texts in order, and puts the vectors of a response back by their
    index (C3). A response that lacks an index fails the task.
    """
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType(), False), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = provider_factory()
        for rb in batches:
            texts = rb.column(text_col).to_pylist()
            vecs = []
            for s in range(0, len(texts), batch):
                part = texts[s:s + batch]
                vecs.append(in_request_order(provider.embed(part), len(part), provider.name))
            mat = np.concatenate(vecs) if vecs else np.zeros((0, provider.dim), np.float32)
            flat = pa.array(mat.reshape(-1), type=pa.float32())
            offsets = pa.array(np.arange(0, mat.shape[0] + 1, dtype=np.int32) * mat.shape[1],
                               type=pa.int32())
            arr = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays(rb.columns + [arr], names=rb.schema.names + [out_col])

    return df.mapInArrow(run, schema)
