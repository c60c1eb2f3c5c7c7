"""Words, 64-bit names and shingles of texts within a Python worker (numpy, Arrow).

``bytes.split`` and ``bytes.lower`` know exactly the contract's white space
(0x20, 0x09-0x0D) and exactly A-Z, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from docsearch_spark.llm.util import SHINGLE_WORDS

STEP = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def named(split: list[list[bytes]]) -> np.ndarray:
    """64-bit names of the words of all texts, one after the other."""
    n = sum(map(len, split))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, n)


def windows(names: np.ndarray, size: int) -> np.ndarray:
    """Name of the ``size`` words that start at each word (fewer at the end: void)."""
    n = max(0, len(names) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * STEP + names[k:k + n]
    return mix(out + np.uint64(size))


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Ascending distinct shingle names of each lower-cased text.

    A text of fewer words is one shingle of its whole sequence; one without
    words has none.
    """
    split = [t.lower().split() for t in texts]
    names = named(split)
    every = windows(names, size)
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= size:
            out.append(np.unique(every[at:at + n - size + 1]))
        else:
            out.append(windows(names[at:at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out
