"""Vectorised splitting of Arrow text columns (runs inside tasks).

A column of texts is handled as one byte buffer with document offsets.
Splits are found with numpy, and equal pieces share one dictionary entry, so
per-word Python work is done once for each distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

# Lower-cases A-Z, keeps a-z, 0-9 and all bytes of non-ASCII characters, and
# turns every other byte into a space.
FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    FOLD[_b] = _b
FOLD[65:91] = np.arange(97, 123)


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of
    ``column``; one longer text is a slice of its own.  Nothing is dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, document offsets); null counts as empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """String array over ``data`` cut at ``starts`` (the first is 0)."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def cut(data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions where ``first`` holds or a document begins, and for
    each document the range of its pieces."""
    flags = first.copy()
    flags[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(flags)
    return starts, np.searchsorted(starts, offsets)


def chunks(data: np.ndarray, offsets: np.ndarray):
    """Pieces of white space followed by a word: (codes, ranges, dictionary).

    The pieces of a document joined give its whole text."""
    space = _SPACE[data]
    first = space.copy()
    first[1:] &= ~space[:-1]
    starts, ranges = cut(data, offsets, first)
    coded = strings(data, starts).dictionary_encode()
    return coded.indices.to_numpy(), ranges, coded.dictionary


def words(data: np.ndarray, offsets: np.ndarray):
    """Words between ``[\\x20\\x09-\\x0D]``: (codes, ranges, dictionary)."""
    codes, ranges, pieces = chunks(data, offsets)
    coded = pc.ascii_ltrim_whitespace(pieces).dictionary_encode()
    vocabulary = coded.dictionary
    codes = coded.indices.to_numpy()[codes] if len(codes) else codes
    empty = pc.index(vocabulary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        keep = codes != empty
        ranges = np.concatenate([[0], np.cumsum(keep)])[ranges]
        codes = codes[keep]
    return codes, ranges, vocabulary


def per_document(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's range."""
    out = np.zeros(len(ranges) - 1, np.int64)
    full = np.flatnonzero(np.diff(ranges))
    if len(full):
        out[full] = np.add.reduceat(values, ranges[full], dtype=np.int64)
    return out


def owner(ranges: np.ndarray) -> np.ndarray:
    """For each piece, the number of its document."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, ranges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every window of ``size`` words inside a document:
    (hash, start position among all words, ranges of the windows)."""
    n = len(hashes)
    counts = np.maximum(np.diff(ranges) - size + 1, 0)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(ranges), np.int64)
    rolled = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j:n - size + 1 + j]
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(ranges[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(rolled[at]), at, out
