"""Elias-Fano code of a non-decreasing sequence of offsets, with sampled select.

``n`` offsets below ``universe`` take ``l = floor(log2(universe / n))`` low bits each, packed, and a
bit vector of high parts in unary: offset ``i`` sets bit ``(offset >> l) + i``. Together about
``2 + l`` bits per offset. ``select1(i)``, hence offset ``i``, starts from a sample of every 256th set
bit. All parts are plain little-endian bytes.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 256


def encode(offsets: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low width, packed low bits, high bit vector, select samples) of ascending ``offsets``."""
    offsets = np.asarray(offsets, dtype=np.uint64)
    n = len(offsets)
    if n == 0:
        return 0, b"", b"", b""
    width = max(0, int(universe // n).bit_length() - 1)
    low = b""
    if width:
        bits = (offsets[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (offsets >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    high[ones] = 1
    return width, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


class Offsets:
    """Random access to an encoded sequence."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    def _select(self, i: int) -> int:
        """Place of set bit ``i``: from its sample on, byte by byte."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return (byte << 3) + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.width
        chunk = int.from_bytes(self.low[first >> 3 : ((first + self.width) >> 3) + 1].tobytes(), "little") >> (first & 7)
        return ((self._select(i) - i) << self.width) | (chunk & ((1 << self.width) - 1))

    def all(self) -> np.ndarray:
        """Every offset, decoded at once."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.width
        if self.width:
            bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
            out |= (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out
