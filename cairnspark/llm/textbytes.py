"""Vectorised word hashing over the UTF-8 buffers of Arrow string arrays.

Texts are cut into groups of about :data:`BLOCK` bytes (a longer text is a
group by itself) so that the expanded arrays stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n; those of very long texts are not kept."""
    if len(_POW[0]) >= n:
        return _POW[0][:n], _POW[1][:n]
    found = []
    for p in (_P, _PINV):
        out = np.full(n, p, np.uint64)
        out[0] = 1
        found.append(np.multiply.accumulate(out))
    if n <= 2 * BLOCK:
        _POW[:] = found
    return found[0], found[1]


def tidied(run):
    """A mapInArrow function that gives free memory back to the system when its task ends: workers stay, beside the JVM."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidy


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 booleans: true for bytes that belong to words."""
    word = np.ones(256, bool)
    for a, b in ranges:
        word[a : b + 1] = False
    return word


#: Words ``[^\\x20\\x09-\\x0D]+``.
SPACE_WORDS = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text.
ALNUM_WORDS = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def groups(offs: np.ndarray, block: int = BLOCK):
    """Slices [i, j) of texts whose bytes together are about ``block``."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + block, "right")) - 1)
        j = min(j, n, i + 4096)
        yield i, j
        i = j


def words(buf: np.ndarray, offs: np.ndarray, word: np.ndarray = SPACE_WORDS, fold: np.ndarray = SAME):
    """Hash, start, end (byte positions) of every word, and n + 1 offsets of the texts' words.

    ``buf`` holds the texts one after the other, ``offs`` (from 0) their bounds.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    is_word = word[buf]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = is_word[cut]
    last[cut - 1] = is_word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((fold[buf].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h = mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))
    return h, start, end, np.searchsorted(start, offs, "left")


#: Odd multipliers of the places in a window, and those of sequences below.
_C = [
    np.uint64(x)
    for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)
]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (over the whole buffer; the caller drops those across texts)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> np.uint64(29))) * (_C[i % 8] + np.uint64(2 * (i // 8)))
    return mix(out)


def sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words, apart from those of windows of another length."""
    acc = len(h) * 0xC2B2AE3D27D4EB4F & _MASK
    for x in h.tolist():
        acc = ((acc ^ x) * 0x9FB21C651E98DF25 + 0x165667B19E3779F9) & _MASK
    return mix(np.array([acc], np.uint64))[0]
