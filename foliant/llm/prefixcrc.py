"""CRC-32 of any substring from the running CRCs of the text that holds it.

A text is scanned once and the CRC of each prefix is stored. Appending n bytes to a text multiplies the part of its CRC
that is due to the earlier bytes by x to the power 8n, a linear map over GF(2). So the CRC of text[lo:hi] is the CRC
of text[:hi] without that of text[:lo] shifted by hi - lo bytes, whatever stands before ``lo``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np

_POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
_SHORT = 64  # shifts by fewer bytes have a table each, others are put together from powers of two

Map = tuple[int, ...]  # a linear map: the images of the 32 single bits


def _apply(m: Map, value: int) -> int:
    out = 0
    for bit, image in enumerate(m):
        if value >> bit & 1:
            out ^= image
    return out


def _after(first: Map, then: Map) -> Map:
    return tuple(_apply(then, image) for image in first)


@cache
def _one_byte() -> Map:
    one_bit: Map = (_POLYNOMIAL, *(1 << bit for bit in range(31)))
    m = one_bit
    for _ in range(3):  # 2, 4, 8 bits
        m = _after(m, m)
    return m


def _lookup(m: Map) -> np.ndarray:
    """For each of the four bytes of a value the image of all 256 bytes."""
    images = np.array(m, np.uint32)
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte] ^= np.where(np.arange(256) >> bit & 1, images[8 * byte + bit], 0).astype(np.uint32)
    return table


@cache
def _short_shifts() -> np.ndarray:
    """Tables of the shifts by 0 to ``_SHORT`` - 1 bytes, one after the other: shift, byte of the value, byte."""
    maps = [tuple(1 << bit for bit in range(32))]
    while len(maps) < _SHORT:
        maps.append(_after(maps[-1], _one_byte()))
    return np.concatenate([_lookup(m).ravel() for m in maps])


@cache
def _power_shift(k: int) -> np.ndarray:
    """The table of the shift by 2**k bytes."""
    m = _one_byte()
    for _ in range(k):
        m = _after(m, m)
    return _lookup(m)


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What is left of each CRC after so many further bytes."""
    low = np.where(n_bytes < _SHORT, n_bytes, 0) * 1024
    tables = _short_shifts()
    out = tables[low + (crc & 255)]
    for byte in range(1, 4):
        out ^= tables[low + (256 * byte + (crc >> np.uint32(8 * byte) & np.uint32(255)))]
    long = np.flatnonzero(n_bytes >= _SHORT)
    if len(long):
        value, left = crc[long], n_bytes[long]
        for k in range(int(left.max()).bit_length()):
            at = np.flatnonzero(left >> k & 1)
            table, v = _power_shift(k), value[at]
            value[at] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
        out[long] = value
    return out


def _scan(words: list[bytes]) -> Iterator[int]:
    """CRC of the text up to each word's end."""
    crc = 0
    for word in words:
        crc = crc32(word, crc)
        yield crc
        crc = crc32(b" ", crc)


class RunningCrc:
    """Words with single spaces between them, and the CRCs of the text up to each word's start and end."""

    def __init__(self, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.at_end = np.fromiter(_scan(words), np.uint32, len(words))
        self.at_start = np.zeros(len(words), np.uint32)
        if len(words):
            self.at_start[1:] = shifted(self.at_end[:-1], np.ones(len(words) - 1, np.int64)) ^ np.uint32(crc32(b" "))

    def grams(self, first: np.ndarray, n: int) -> np.ndarray:
        """CRC-32 of the ``n`` words from each ``first``, joined by single spaces."""
        last = first + (n - 1)
        return self.at_end[last] ^ shifted(self.at_start[first], self.end[last] - self.start[first])
