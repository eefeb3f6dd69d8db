"""Vector kernels over the bytes of Arrow string columns: words, word hashes, window hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D, that is `[^\\x20\\x09-\\x0D]+`.
Hashes go through SplitMix64's finaliser at each step, so they are no linear function of bytes or words, of which
structured texts could make equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ODD = U64(0x9E3779B97F4A7C15)
#: Bytes handled at once; keeps temporaries in cache and bounds memory for long texts.
STEP = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = space[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    solid = ~gap[1:-1]
    starts = np.flatnonzero(solid & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid & (gap[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _keys(seed: int, n: int) -> list[np.uint64]:
    return [U64(x) for x in mix64(np.arange(n, dtype=U64) + U64(seed * 1009 + 1)).tolist()]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A word's hash mixes its bytes as two numbers, so words of up to 8 bytes and the same length never share one; over 16 bytes XXH3 takes them all."""
    low, high, size = _keys(seed, 3)
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the number of eight bytes from each place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    out = np.empty(len(starts), U64)
    for i in range(0, len(starts), STEP // 8):
        s = starts[i : i + STEP // 8]
        n = ends[i : i + STEP // 8] - s
        one, two = mix64((at[s] & mask[np.minimum(n, 8)]) ^ low), mix64((at[s + np.minimum(n, 8)] & mask[np.clip(n - 8, 0, 8)]) ^ high)
        out[i : i + len(s)] = mix64(one * ODD + (two >> U64(29) ^ two) + n.astype(U64) * size)
    view = memoryview(padded)
    for k in np.flatnonzero(ends - starts > 16).tolist():
        out[k] = xxh3_64_intdigest(view[starts[k] : ends[k]], int(low))
    return out


def window_hashes(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of each window of `length` consecutive hashes, also across texts; mask those with `inside`.

    Windows of 1, 2, 4 ... are mixed of two halves each; those of the powers in `length` follow one another.
    """
    n, step = len(hashes) - length + 1, STEP // 4
    if n <= 0:
        return np.zeros(0, U64)
    out, (key, link) = np.empty(n, U64), _keys(seed, 2)
    for i in range(0, n, step):
        part = hashes[i : min(i + step, n) + length - 1]
        m, half, whole, used = len(part) - length + 1, mix64(part ^ key), None, 0
        for k in range(length.bit_length()):
            if k:
                half = mix64(half[: -(1 << k - 1)] * ODD + half[1 << k - 1 :])
            if length >> k & 1:
                whole = half[:m] if whole is None else mix64(whole * (link | U64(1)) + half[used : used + m])
                used += 1 << k
        out[i : i + m] = whole
    return out


def inside(first: np.ndarray, length: int) -> np.ndarray:
    """Indexes of the words at which a window of `length` words of one text starts."""
    n = np.maximum(np.diff(first) - length + 1, 0)
    return ranges(first[:-1], n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] of them, then the same for the next."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about `size` bytes of the column's text at a time, one row at the least."""
    off, i = buffer_of(batch.column(column))[1], 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
