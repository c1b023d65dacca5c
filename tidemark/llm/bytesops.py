"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are held as arrays at once; a longer text makes a chunk of its own.
CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
#: One random odd word for each byte value.
BYTE_WORDS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _powers:
        for kept in [k for k in _powers if k > 2 * CHUNK]:  # of a very long text
            del _powers[kept]
        out = []
        for base in (BASE, INVERSE):
            a, step = np.ones(size, dtype=np.uint64), 1
            while step < size:
                a[step : 2 * step] = a[:step] * np.uint64(pow(base, step, 1 << 64))
                step *= 2
            out.append(a)
        _powers[size] = (out[0], out[1])
    up, down = _powers[size]
    return up[:n], down[:n]


def trim() -> None:
    """Gives freed memory back: a worker that waits for its next task shall not hold what the last one needed."""
    for kept in [k for k in _powers if k > 2 * CHUNK]:
        del _powers[kept]
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run, an iterator over batches, with trim() at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def trimmed_group(run: Callable) -> Callable:
    """run, a function of one or two tables, with trim() at its end."""
    if run.__code__.co_argcount == 1:

        def one(t: pa.Table) -> pa.Table:
            out = run(t)
            trim()
            return out

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        trim()
        return out

    return two


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of BYTE_WORDS[data[j]] * BASE**j over j < i, modulo 2**64."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(BYTE_WORDS[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, whatever the place."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


#: Words of more bytes than this are hashed one by one.
LONG = 64
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, eight bytes a step and each step mixed, so that no pattern of bytes cancels out.

    Prefix sums (span_hashes) hash any span at once, but modulo 2**64 some patterns collide under every base; where two things count
    as equal by their hashes alone, they are hashed here.
    """
    size = end - start
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    left, at = np.flatnonzero((size <= LONG) & (size > 0)), 0
    while len(left):
        rest = size[left] - at
        out[left] = mix((out[left] ^ lanes[start[left] + at] & _BELOW[np.minimum(rest, 8)]) * np.uint64(BASE) + np.uint64(at + 1))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the n + 1 places where they begin; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, places) of runs of whole texts of about `most` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space, and the row it is in; runs end with the text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    edges = at[:-1][at[:-1] < n]
    before[edges] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = at[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] places, then those of start[1], and so on."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)
