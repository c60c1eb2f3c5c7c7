"""Chunking by a hierarchy of separators (B4), as the legacy ingestion cut its pages.

A text is cut at the first separator of ``SEPARATORS`` that it holds; a separator stays
with the piece behind it. Pieces of ``size`` characters or more are cut at the next
separator, down to single characters. Neighbouring smaller pieces of one cut are packed
greedily: a chunk takes pieces while it has at most ``size`` characters, and the next one
starts with as many of its last pieces as have at most ``overlap`` characters and leave
room for the piece that follows. Chunks are stripped, and blank ones dropped.

Packing is a chain of decisions, so it runs in an Arrow UDF, a row at a time on
offsets only: borders come from one array of code points, and each chunk costs two binary
searches, whatever its number of pieces. No shuffle; chunks come out by ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch_spark.functions.text import or_empty
from docsearch_spark.operators.chunking import check_chunk_params
from docsearch_spark.schemas import LEGACY_CHUNK_OVERLAP, LEGACY_CHUNK_SIZE

#: From the coarsest cut to the finest; after them a text is cut into characters.
SEPARATORS = ("\n\n", "\n", " ")


def piece_borders(points: np.ndarray, a: int, b: int, separator: str) -> np.ndarray:
    """Where the pieces of points[a:b] start, and b; separators are matched from the left."""
    hit = points[a:b] == ord(separator[0])
    at = np.flatnonzero(hit)
    if len(separator) > 1:  # every second position of a run, while one is left behind it
        first = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
        nth = at - np.repeat(first, np.diff(np.r_[np.searchsorted(at, first), len(at)])) if len(at) else at
        followed = np.r_[hit[1:], False][at]
        at = at[(nth % len(separator) == 0) & followed]
    return np.r_[a, at[at > 0] + a, b]


def packed(borders: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the chunks of consecutive pieces, each smaller than ``size``."""
    first, last = 0, len(borders) - 1
    while first < last:
        end = int(np.searchsorted(borders, borders[first] + size, "right")) - 1
        yield int(borders[first]), int(borders[end])
        if end == last:
            return
        least = max(borders[end] - overlap, borders[end + 1] - size)
        first = min(end, int(np.searchsorted(borders, least, "left")))


def spans(points: np.ndarray, a: int, b: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the chunks of points[a:b], cut from separator ``level`` on."""
    while level < len(SEPARATORS):
        borders = piece_borders(points, a, b, SEPARATORS[level])
        level += 1
        # a separator at the very start is one, though it cuts nothing
        found = len(borders) > 2 or _starts_with(points, a, b, SEPARATORS[level - 1])
        if found:
            break
    else:
        yield from packed(np.arange(a, b + 1), size, overlap)
        return
    large = np.flatnonzero(np.diff(borders) >= size)
    done = 0
    for i in large:
        yield from packed(borders[done:i + 1], size, overlap)
        yield from spans(points, int(borders[i]), int(borders[i + 1]), level, size, overlap)
        done = i + 1
    yield from packed(borders[done:], size, overlap)


def _starts_with(points: np.ndarray, a: int, b: int, separator: str) -> bool:
    return b - a >= len(separator) and all(points[a + i] == ord(c) for i, c in enumerate(separator))


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """The chunks of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    chunks = (text[a:b].strip() for a, b in spans(points, 0, len(text), 0, size, overlap))
    return [c for c in chunks if c]


def chunk_recursive(df: DataFrame, text_col: str = "text", size: int = LEGACY_CHUNK_SIZE,
                    overlap: int = LEGACY_CHUNK_OVERLAP) -> DataFrame:
    """Every other column, ``chunk_index INT`` and ``content``, a row a chunk.

    Null and blank texts have no chunks. ``size`` counts characters (code points) and is
    at least 2.
    """
    check_chunk_params(size, overlap)
    if size < 2 or overlap < 0:
        raise ValueError(f"chunk_size must be at least 2 and overlap not negative, got {size}, {overlap}")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    out = df.select("*", F.posexplode(split(or_empty(text_col))).alias("chunk_index", "content")).drop(text_col)
    return out.withColumn("chunk_index", F.col("chunk_index").cast("int"))
