"""Vectorised word and byte n-gram hashing over the raw buffers of Arrow string arrays.

All functions work on one concatenated byte buffer with document offsets, so that no Python
object is made per word.  Word hashes are multilinear in a random byte table; n-gram hashes are
multilinear in the (mixed) unit hashes, and are finalised with a bijective 64-bit mixer.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Word separators: the bytes 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE_TABLE = _RNG.integers(1, 2**64, 256, dtype=U64, endpoint=False)
_STEP = U64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_MULTIPLIERS = _RNG.integers(0, 2**63, 4096, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=U64)
    out[0] = 1
    out[1:] = _STEP
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    return _powers(max(64, 1 << (max(n, 1) - 1).bit_length()))[:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together (or one longer document)."""
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word, in order; words end at document borders."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    space = IS_SPACE[buf]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = True
    last[off[1:][full] - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.empty(0, U64)
    lens = ends - starts
    total = np.cumsum(lens)
    at = total - lens
    inside = np.arange(total[-1]) - np.repeat(at, lens)
    part = _BYTE_TABLE[buf[inside + np.repeat(starts, lens)]]
    part *= powers(int(lens.max()))[inside]
    return mix(np.add.reduceat(part, at) + lens.astype(U64) * _STEP)


def multilinear(unit: np.ndarray, n: int, shifts: list[int], salt: int) -> np.ndarray:
    """For each of n places i: mixed sum of unit[i + shifts[j]] times a fixed odd multiplier."""
    if n <= 0:
        return np.empty(0, U64)
    acc = unit[shifts[0] : shifts[0] + n] * _MULTIPLIERS[salt]
    for j, s in enumerate(shifts[1:], 1):
        acc += unit[s : s + n] * _MULTIPLIERS[salt + j]
    return mix(acc)


def multilinear_at(unit: np.ndarray, at: np.ndarray, shifts: list[int], salt: int) -> np.ndarray:
    """As multilinear, at the given places only."""
    if len(at) == 0:
        return np.empty(0, U64)
    acc = unit[at + shifts[0]] * _MULTIPLIERS[salt]
    for j, s in enumerate(shifts[1:], 1):
        acc += unit[at + s] * _MULTIPLIERS[salt + j]
    return mix(acc)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:]) if len(a) > size else a[:0]
        size *= 2
    if size < w:
        d = w - size
        a = np.minimum(a[:-d], a[d:]) if len(a) > d else a[:0]
    return a


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = np.cumsum(lens)
    if len(total) == 0 or total[-1] == 0:
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lens), lens)
