"""Text preparation and chunking.

Chunking is a row-local generator (``sequence`` + ``posexplode`` +
``substring``): no shuffle, no Python, one output row per window. Large
documents produce many rows from one input row, so callers that do heavy
per-chunk work afterwards (embedding) repartition the chunk table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch_spark.functions.text import col_, let, normalize_ws, or_empty, py_strip
from docsearch_spark.schemas import (DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE,
                                     LEGACY_CHUNK_OVERLAP, LEGACY_CHUNK_SIZE)


def check_chunk_params(size: int, overlap: int) -> None:
    """The recurrence only advances when size > 0 and overlap < size."""
    if size <= 0:
        raise ValueError(f"chunk_size must be positive, got {size}")
    if overlap >= size:
        raise ValueError(f"overlap must be smaller than chunk_size, got {overlap} >= {size}")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Number of windows the sliding recurrence produces over n characters.

    Window i starts at i*step (step = size - overlap) and is produced while the
    previous window did not reach the end and its own start is inside the text.
    """
    step = size - overlap
    if step <= size:  # overlap >= 0: the start condition is implied
        many = F.lit(1) + F.floor((n - F.lit(size) + F.lit(step - 1)) / F.lit(step))
    else:             # gaps between windows: the end condition is implied
        many = F.floor((n + F.lit(step - 1)) / F.lit(step))
    return (F.when(n <= 0, F.lit(0)).when(n <= F.lit(size), F.lit(1))
            .otherwise(many).cast("int"))


def normalize_text(df: DataFrame, text_col: str = "text", out: str = "text") -> DataFrame:
    """B1: whitespace runs become one space, ends trimmed; null becomes ''."""
    return df.withColumn(out, normalize_ws(or_empty(text_col)))


def drop_empty(df: DataFrame, text_col: str = "text") -> DataFrame:
    """B2: documents whose normalised text is empty yield no chunks."""
    return df.filter(F.length(col_(text_col)) > 0)


#: Windows cut from one coarse segment. ``substring`` counts characters from the
#: start of its text, so windows are cut from short segments, not from the text.
SEGMENT_WINDOWS = 16


def segments(t: Column, size: int, overlap: int) -> Column:
    """The text in consecutive pieces of ``SEGMENT_WINDOWS`` steps, each with what
    its last window reaches over into the next: one linear pass, whatever the length."""
    step = size - overlap
    span = max(SEGMENT_WINDOWS, -(-max(overlap, 0) // step)) * step
    return let(F.when(F.length(t) <= span, F.array(t)).otherwise(
        F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % span), F.lit(0))),
        lambda parts: parts if overlap <= 0 else F.transform(parts, lambda x, j: F.concat(
            x, F.coalesce(F.substring(F.get(parts, j + 1), 1, overlap), F.lit("")))))


def segment_windows(part: Column, j: Column, n: Column, size: int, overlap: int) -> Column:
    """The trimmed windows that start in segment ``j`` of a text of ``n`` characters."""
    step = size - overlap
    per = max(SEGMENT_WINDOWS, -(-max(overlap, 0) // step))
    here = F.least(F.lit(per), window_count(n, size, overlap) - j * F.lit(per))
    return F.when(here > 0, F.transform(
        F.sequence(F.lit(0), here - F.lit(1)),
        lambda i: F.trim(F.substring(part, i * F.lit(step) + F.lit(1), F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def chunk_fixed(df: DataFrame, text_col: str = "text",
                size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                normalized: bool = False, keep_text: bool = False) -> DataFrame:
    """Overlapping character windows over the normalised text.

    Output: every input column (the text column only with ``keep_text``) plus
    ``chunk_index INT`` (position among non-empty windows) and ``content``.

    Window i is ``trim(substring(t, i*step + 1, size))``. A text is first cut into
    coarse segments, which are exploded; the windows are cut inside a segment,
    so time is linear in the length of the text. On whitespace normalised text a
    window of two or more characters can never be blank (no two spaces are
    adjacent and the text does not end in one), so for size >= 2 the window's
    number follows from its segment. With size == 1 blank windows exist and are
    removed inside the row before numbering.
    """
    check_chunk_params(size, overlap)
    step = size - overlap
    t, n = "__t", "__n"
    base = df.withColumn(t, col_(text_col) if normalized else normalize_ws(or_empty(text_col)))
    base = base.withColumn(n, F.length(t))
    if not keep_text:
        base = base.drop(text_col)
    if size >= 2:
        per = max(SEGMENT_WINDOWS, -(-max(overlap, 0) // step))
        cut = base.withColumn(t, segments(F.col(t), size, overlap))
        # outer: of a plain explode the planner infers a filter that cuts every text once more;
        # an empty text has one empty segment, which has no window
        cut = cut.select(*[c for c in cut.columns if c != t], F.posexplode_outer(t).alias("__j", "__part"))
        out = cut.select(*[c for c in cut.columns if c != "__part"], F.posexplode(
            segment_windows(F.col("__part"), F.col("__j"), F.col(n), size, overlap)).alias("__i", "content"))
        out = out.withColumn("chunk_index", F.col("__j") * F.lit(per) + F.col("__i"))
        out = out.select(*[c for c in out.columns if c not in ("content", "chunk_index")],
                         "chunk_index", "content").drop("__i", "__j")
    else:
        chars = F.filter(_windows(F.col(t), size, overlap), lambda c: F.length(c) > 0)
        out = base.select("*", F.posexplode(chars).alias("chunk_index", "content")).drop(t)
    return out.drop(n).withColumn("chunk_index", F.col("chunk_index").cast("int"))


def _windows(t: Column, size: int, overlap: int) -> Column:
    """All windows of a text in order, segment by segment."""
    return let(F.length(t), lambda n: F.flatten(F.transform(
        segments(t, size, overlap), lambda part, j: segment_windows(part, j, n, size, overlap))))


def chunk_by_separator(df: DataFrame, text_col: str = "text",
                       size: int = LEGACY_CHUNK_SIZE,
                       overlap: int = LEGACY_CHUNK_OVERLAP) -> DataFrame:
    """B4 (own definition): split the raw text at newline runs, normalise each
    piece, drop empty pieces, apply ``chunk_fixed(size, overlap)`` per piece and
    number the chunks across the document by (piece, window).

    The numbering is a row-local ``posexplode`` over the flattened per-document
    array: no window function and no shuffle. Long pieces are cut by segments, as
    in :func:`chunk_fixed`.
    """
    check_chunk_params(size, overlap)
    pieces = F.filter(F.transform(F.split(or_empty(text_col), r"\n+"), lambda p: normalize_ws(p)),
                      lambda p: F.length(p) > 0)
    flat = F.filter(F.flatten(F.transform(pieces, lambda p: _windows(p, size, overlap))),
                    lambda c: F.length(c) > 0)
    out = df.select("*", F.posexplode(flat).alias("chunk_index", "content")).drop(text_col)
    return out.withColumn("chunk_index", F.col("chunk_index").cast("int"))


def doc_text(title, text) -> Column:
    """``f"{title.strip()}\\n{text.strip()}".strip()``, missing parts are ''."""
    return py_strip(F.concat(py_strip(or_empty(title)), F.lit("\n"), py_strip(or_empty(text))))
