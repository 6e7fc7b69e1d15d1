"""Hashes of word sequences, computed for whole texts at once.

A word is a run of bytes other than white space. The words of a text, joined by single spaces, get one polynomial
prefix hash, from which the hash of any word follows by one subtraction and one product. The hash of a sequence mixes
in one word after the other; the polynomial alone would give some long strings of two letters the same hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20  # bytes hashed at a time
_LONGEST = 64  # a longer word is replaced by its digest
_NEXT = np.uint64(0x9FB21C651E98DF25)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.cumprod(table, dtype=np.uint64)
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: bytes) -> list[bytes]:
    """Runs of bytes that are not white space (blank, tab to carriage return), A-Z in lower case."""
    return text.lower().split()


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of some bytes: entry i covers the first i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def between(prefixes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the bytes lo..hi, wherever they stand."""
    return mix((prefixes[hi] - prefixes[lo]) * powers(_INVERSE, len(prefixes))[lo])


def sequences(found: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``k`` words in order, in arrays of bounded size; of fewer words, of all of them."""
    if not found:
        return
    k = min(k, len(found))
    joined = b" ".join([w if len(w) <= _LONGEST else b"\x00" + hashlib.sha256(w).hexdigest().encode() for w in found])
    data = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(data))
    lo, n = 0, len(starts) - k + 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(starts, starts[lo] + _SEGMENT))))
        first, last = starts[lo : hi + k - 1] - starts[lo], ends[lo : hi + k - 1] - starts[lo]
        word = between(prefix(data[starts[lo] : ends[hi + k - 2]]), first, last)
        run = word[: hi - lo]
        for i in range(1, k):
            run = mix(run * _NEXT + word[i : i + hi - lo])
        yield run
        lo = hi


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words."""
    parts = list(sequences(words(text), k))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
