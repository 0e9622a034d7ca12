"""Word shingles of texts as 64-bit hashes, computed on whole Arrow buffers.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased. Both rules only
look at single bytes of UTF-8, so no text is decoded. A word's hash is a polynomial
over its bytes, taken from running sums; a shingle's hash combines its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mixed

# Odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = tuple(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16))
#: Bytes of text that are hashed at a time; what a byte needs stays near the processor.
PIECE = 1 << 15


#: Bytes of text that are shingled at a time; what a text needs is about ten times its size.
SLICE_BYTES = 1 << 18


def slices(batch: pa.RecordBatch, column: int | str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about as many bytes of text, one row at least.

    What is built from a piece can be dropped before the next, so memory does not follow
    the number of rows that happen to come in one batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0)
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, before + most_bytes, side="right")))
        yield batch.slice(low, high - low)
        low = high
    pa.default_memory_pool().release_unused()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _powers(n: int, base: int) -> np.ndarray:
    if n <= PIECE:
        return _piece_powers(base)[:n]
    return _all_powers(n, base)


def _all_powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _piece_powers(base: int) -> np.ndarray:
    return _all_powers(PIECE, base)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each text.

    Works piece by piece, so that memory beyond the result stays small.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[bounds] = True
    inside = ~gap
    starts = inside.copy()
    starts[1:] &= gap[:-1] | first[1:-1]
    last = inside.copy()
    last[:-1] &= gap[1:] | first[1:-1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    out = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + PIECE, side="right")))
        low, high = begin[at], end[upto - 1]
        part = raw[low:high]
        part = part + np.where((part >= 65) & (part <= 90), 32, 0).astype(np.uint8)
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(n, BASE), out=sums[1:])
        b, e = begin[at:upto] - low, end[at:upto] - low
        value = (sums[e] - sums[b]) * _powers(n, INVERSE)[b]
        out[at:upto] = mixed(value + (e - b).astype(np.uint64) * np.uint64(BASE))
        at = upto
    return out, np.searchsorted(begin, bounds)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values, in an array of their own; ``values`` is sorted in place.

    ``np.unique`` goes through a hash table, which takes several times as long.
    """
    values.sort()
    fresh = np.empty(len(values), dtype=bool)
    fresh[:1] = True
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order.

    A text of fewer than ``k`` words is one shingle; one without words has none.
    """
    words, before = word_hashes(*buffers(texts))
    n = len(words)
    whole = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        whole += words[j : n - k + 1 + j] * np.uint64(SHINGLE[j])
    whole = mixed(whole)
    for low, high in zip(before[:-1], before[1:]):
        if high - low >= k:
            yield distinct(whole[low : high - k + 1])
        elif high > low:
            short = sum(int(w) * SHINGLE[j] for j, w in enumerate(words[low:high])) + int(high - low)
            yield mixed(np.array([short % (1 << 64)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signed_sets(texts: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of all texts, and one signed 64-bit number per set, independent of order; 0 for an empty set."""
    sets = list(shingle_sets(texts, k))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    upto = np.zeros(int(sizes.sum()) + 1, dtype=np.uint64)
    if sets:
        np.cumsum(mixed(np.concatenate(sets) ^ np.uint64(SHINGLE[3])), out=upto[1:])
    ends = np.cumsum(sizes)
    sigs = mixed(upto[ends] - upto[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
    sigs[sizes == 0] = 0
    return sets, sigs
