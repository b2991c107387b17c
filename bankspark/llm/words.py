"""Words and five-word shingles as 64-bit numbers."""

from __future__ import annotations

import ctypes
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def ascii_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than 20 and 09 to 0D, A-Z in lower case."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[list]) -> np.ndarray:
    """Hashes of the words of all documents, one after the other."""
    n = sum(map(len, words))
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, n)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words in one row of word hashes; of the whole row if it is shorter.

    Rows of different numbers of words below ``size`` start from different numbers, so they never
    count as the same run.
    """
    length = min(size, len(hashes))
    if length == 0:
        return np.empty(0, np.uint64)
    count = len(hashes) - length + 1
    total = np.full(count, length, np.uint64)
    for k in range(length):
        total = total * np.uint64(_BASE & _MASK) + hashes[k : k + count]
    return mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def release() -> None:
    """Gives memory that is free back to the machine, where the C library can: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column: str = "text", limit: int = 8 << 20):
    """Parts of Arrow batches of about ``limit`` bytes of text, so that long texts don't add up in memory."""
    release()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit)))
            yield batch.slice(start, stop - start)
            start = stop
        # Not held while the next batch is made.
        del batch
    release()
