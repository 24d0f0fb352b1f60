"""Vectorised helpers over Arrow text columns, used inside tasks only.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D, so words never split a code point. Work goes through blocks
of bounded size; nothing here keeps more than one record batch.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple] = {}
_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives memory of earlier batches back, since Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if len(column) > 1:
        release()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = 4 * BLOCK):
    """(first document, data, offsets) of runs of whole documents of about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word."""
    w = _WORD[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    o = offsets[:-1][offsets[:-1] < len(w)]
    first[o] = w[o]
    o = offsets[1:][offsets[1:] > 0] - 1
    last[o] = w[o]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _table(seed: int):
    if seed not in _tables:
        base = mix(np.arange(1, 3, dtype=np.uint64) * np.uint64(2 * seed + 0x9E3779B97F4A7C15 % (1 << 63) | 1))[0] | np.uint64(5)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, base)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, inverse)]), dtype=np.uint64)
        letters = mix(np.arange(256, dtype=np.uint64) + np.uint64((seed + 1) << 20))
        _tables[seed] = letters, powers, back
    return _tables[seed]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap.

    The sum of letter codes times powers of an odd base, taken for all spans of a
    block from one prefix sum and moved to power 0 by the base's inverse.
    """
    letters, powers, back = _table(seed)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + BLOCK, "right"))
        if j <= i:  # a word longer than a block
            digest = hashlib.blake2b(data[at : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        part = data[at : ends[j - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * powers[: len(part)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (also across documents: filter by document)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xA24BAED4963EE407) + h[j : j + n]
    return mix(out + np.uint64(k))


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct hashes of k-word shingles) of each text, A-Z lower-cased.

    Fewer than k words make one shingle of the whole sequence; no word, an empty set.
    """
    for first, data, offsets in chunks(*utf8(column)):
        data = lower(data)
        starts, ends, doc = words(data, offsets)
        h = hashes(data, starts, ends)
        g = grams(h, k)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        for d in range(len(offsets) - 1):
            a, b = bounds[d], bounds[d + 1]
            if b - a >= k:
                yield first + d, np.unique(g[a : b - k + 1])
            else:
                yield first + d, grams(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)
