"""Vectorised word and shingle hashes over Arrow string columns, for use inside tasks.

A slice of documents is one byte array. Words are runs of bytes other than space, tab, newline,
vertical tab, form feed and carriage return; A-Z are lower-cased. A word's 64-bit hash is a
multilinear hash of its bytes, a shingle's one of its words' hashes. Two different shingles of a
pair of sets share a hash with odds near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def weights(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random multipliers."""
    start = np.uint64(seed * 0x1000003 & 0xFFFFFFFF)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + start) * np.uint64(_STEP)) | np.uint64(1)


_BYTE_WEIGHTS = weights(64, 1)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``limit`` bytes.

    A single longer text makes a slice of its own. Null texts are empty.
    """
    column = batch.column(text).cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segments(data: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A hash of the kept bytes of each segment; segments run from one start to the next."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    longest = int(lengths.max())
    factor = _BYTE_WEIGHTS if longest <= len(_BYTE_WEIGHTS) else weights(longest, 1)
    ends = np.cumsum(lengths)
    place = np.arange(int(ends[-1]), dtype=np.int32) - np.repeat((ends - lengths).astype(np.int32), lengths)
    value = factor[place]
    value *= (data[starts[0] :] + keep[starts[0] :].astype(np.uint16)) * keep[starts[0] :]  # bytes that are not kept count as 0
    return mix(np.add.reduceat(value, starts - starts[0]))


def lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_mask(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, first word of each document and after the last)."""
    inside = word_mask(data)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    hashes = segments(lower(data) if fold else data, starts, inside)
    return hashes, starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``k`` words within a document, first shingle of each document).

    A document of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    factor = weights(k, 2)
    counts = np.diff(first)
    total = len(hashes)
    runs = np.zeros(max(0, total - k + 1), np.uint64)
    for i in range(k):
        runs += hashes[i : i + len(runs)] * factor[i]
    runs = mix(runs + np.uint64(k))
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    long = counts >= k
    which = np.repeat(first[:-1][long] - bounds[:-1][long], sizes[long])
    out = np.empty(int(bounds[-1]), np.uint64)
    target = np.arange(len(out))
    full = np.repeat(long, sizes)
    out[full] = runs[target[full] + which]
    for d in np.flatnonzero(~long & (counts > 0)):
        own = hashes[first[d] : first[d + 1]]
        out[bounds[d]] = mix(np.array([(own * factor[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    return out, bounds


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def distinct_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    hashes, _, first = words(data, offsets)
    runs, bounds = shingles(hashes, first, k)
    return [np.unique(runs[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]


def parity(hashes: np.ndarray) -> bytes:
    """A bit per bucket of a set: whether an odd number of its hashes fall there.

    There are at least as many buckets as hashes, a power of two and no less than 64. Where two
    such sketches differ, exactly one of the sets has a hash of its own.
    """
    size = 1 << max(6, int(len(hashes) - 1).bit_length() if len(hashes) else 0)
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of hashes that only one of two sets has, from their ``parity``.

    The longer sketch is folded: a bucket's parity is that of the buckets it is split into.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return int(np.unpackbits(np.bitwise_xor.reduce(a.reshape(-1, size)) ^ np.bitwise_xor.reduce(b.reshape(-1, size))).sum())
