"""Elias-Fano coded ascending sequences, read in place: select, access and successor search on the coded bits.

A sequence of n values up to u takes about n * (2 + log2(u / n)) bits: the lower bits of each value side by side, the
upper bits in unary, and the place of every SAMPLE-th one and zero of the unary part.
"""

from __future__ import annotations

import numpy as np

#: Every so many ones, and zeros, of the upper bits, their place is kept.
SAMPLE = 64

_U = np.uint64
_63 = np.int64(63)


def low_width(n: int, top: int) -> int:
    """Lower bits of each of n values of which `top` is the largest."""
    return min(56, max(0, (top // n).bit_length() - 1)) if n else 0


def pack_low(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value side by side, little-endian."""
    if not width:
        return b""
    n = len(values)
    eights = np.zeros((-(-n // 8), 8), _U)
    eights.ravel()[:n] = values & _U((1 << width) - 1)
    out = np.zeros((len(eights), width + 8), np.uint8)
    for j in range(8):
        shifted = eights[:, j] << _U(j * width & 7)
        for k in range((width + 14) // 8):
            out[:, (j * width >> 3) + k] |= (shifted >> _U(8 * k)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :width]).tobytes()[: (n * width + 7) // 8]


def _padded(data: bytes) -> bytes:
    """Whole words and one more, as reads take 8 bytes."""
    return data + b"\0" * (16 - len(data) % 8)


def encode(values: np.ndarray) -> dict:
    """Parts of a coded sequence: n, width, and as bytes low, high, ones and zeros (samples), of 8-byte words each."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = low_width(n, top)
    values = values.astype(_U)
    places = (values >> _U(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(places[-1]) + 2 if n else 0, np.uint8)
    bits[places] = 1
    zeros = np.flatnonzero(bits == 0)[::SAMPLE]
    return {
        "n": n, "width": width, "low": _padded(pack_low(values, width)), "high": _padded(np.packbits(bits, bitorder="little").tobytes()),
        "ones": _padded(places[::SAMPLE].astype("<u4").tobytes()), "zeros": _padded(zeros.astype("<u4").tobytes()),
    }


class Sequence:
    """A coded sequence; the parts are bytes or views of a memory map and are never unpacked."""

    def __init__(self, parts: dict):
        self.n, self.width = parts["n"], parts["width"]
        self.low = np.ndarray((len(parts["low"]) - 7,), "<u8", parts["low"], strides=(1,))
        self.high = np.frombuffer(parts["high"], "<u8")
        self.ones, self.zeros = (np.frombuffer(parts[k], "<u4") for k in ("ones", "zeros"))

    def _select(self, i: np.ndarray, samples: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Places of bits i (ones, or zeros if all bits are flipped): from the nearest sample by counts of whole words, and
        inside a word by halving."""
        place = samples[i // SAMPLE].astype(np.int64)
        left = (i % SAMPLE).astype(_U)
        word = (self.high[place >> 6] ^ flip) >> (place & _63).astype(_U)
        ones = np.bitwise_count(word)
        moving = np.flatnonzero(left >= ones)
        while len(moving):
            left[moving] -= ones[moving]
            place[moving] = ((place[moving] >> 6) + 1) << 6
            word[moving] = self.high[place[moving] >> 6] ^ flip
            ones[moving] = np.bitwise_count(word[moving])
            moving = moving[left[moving] >= ones[moving]]
        shift = np.zeros(len(word), _U)
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((word >> shift) & _U((1 << width) - 1))
            beyond = left >= part
            left -= part * beyond
            shift += _U(width) * beyond
        return place + shift.astype(np.int64)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values i."""
        i = i.astype(np.int64)
        return ((self._select(i, self.ones, _U(0)) - i).astype(_U) << _U(self.width)) | self.low_of(i)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """For each value the first place whose value is not smaller; n if there is none.

        The zeros of the upper bits tell where the values with the same upper bits are; among those the lower bits are
        searched by halving.
        """
        if not self.n:
            return np.zeros(len(wanted), np.int64)
        upper = (wanted >> _U(self.width)).astype(np.int64)
        last = int(self.at(np.array([self.n - 1]))[0]) >> self.width
        inside = upper <= last
        place = np.full(len(wanted), self.n, np.int64)
        upper, lower = upper[inside], wanted[inside] & _U((1 << self.width) - 1)
        begin = np.zeros(len(upper), np.int64)
        after = np.flatnonzero(upper > 0)
        begin[after] = self._select(upper[after] - 1, self.zeros, ~_U(0)) - (upper[after] - 1)
        end = self._select(upper, self.zeros, ~_U(0)) - upper
        moving = np.flatnonzero(begin < end)
        while len(moving):
            middle = (begin[moving] + end[moving]) >> 1
            less = self.low_of(middle) < lower[moving]
            begin[moving[less]] = middle[less] + 1
            end[moving[~less]] = middle[~less]
            moving = moving[begin[moving] < end[moving]]
        place[inside] = begin
        return place
