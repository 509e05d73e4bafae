"""Vectorised text kernels over Arrow string buffers: words, 64-bit hashes, lower case.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes take eight bytes a round through multiplications
and shifts under a key, beginning with the length; long spans go through XXH3. They agree on every machine. Two
different spans of one length up to eight bytes never agree, other ones with a probability of 2**-64; ``span_checks``
gives a second hash under another key, by which a match is confirmed.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash



def _lean_memory() -> None:
    """Have freed arrays go back to the system at once: workers live long, and their peaks would add up."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.util.find_library("c")
    mallopt = getattr(ctypes.CDLL(libc), "mallopt", None) if libc else None
    if mallopt:
        mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD
        mallopt(-8, 2)  # M_ARENA_MAX


_lean_memory()

_KEYS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_MASK = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
LONG = 128
"""Spans of more bytes are hashed one by one."""
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each text the number of the first word (one more at the end)."""
    word = ~SPACE[buf]
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    begins[inner] |= word[inner]
    stops[inner - 1] |= word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets, "left")


def _hashes(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, key: tuple[int, int], block: int = 1 << 16) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    step, seed = np.uint64(key[0]), np.uint64(key[1])
    for i in range(0, len(starts), block):
        at, left = starts[i : i + block], size[i : i + block]
        h = (left.astype(np.uint64) + seed) * step
        rows = np.flatnonzero(left <= LONG)
        done = 0
        while len(rows):
            x = eight[at[rows] + done] & _MASK[np.minimum(left[rows] - done, 8)]
            y = (h[rows] ^ x) * step
            y = (y ^ (y >> np.uint64(29))) * seed
            h[rows] = y ^ (y >> np.uint64(32))
            done += 8
            rows = rows[left[rows] > done]
        for k in np.flatnonzero(left > LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(buf[at[k] : at[k] + left[k]], key[1])
        out[i : i + block] = mix(h)
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; memory stays in proportion to the buffer and the number of spans."""
    return _hashes(buf, starts, ends - starts, _KEYS[0])


def span_checks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second value of each span: with the hash and this, spans up to eight bytes are told apart for certain (it is
    their length) and others by 128 bits."""
    size = ends - starts
    out = size.astype(np.uint64)
    more = np.flatnonzero(size > 8)
    out[more] = _hashes(buf, starts[more], size[more], _KEYS[1])
    return out


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z in lower case, and each text's first word."""
    low = LOWER[buf]
    starts, ends, first = word_bounds(low, offsets)
    return span_hashes(low, starts, ends), first


_C = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole where it has fewer; none without words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    take = min(k, n)
    h = np.full(n - take + 1, np.uint64(take), np.uint64)
    for j in range(take):
        h = h * _C + words[j : n - take + 1 + j]
        h ^= h >> np.uint64(29)
    return mix(h)
