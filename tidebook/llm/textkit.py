"""Words, hashes and windows of many texts at once, on the byte buffers that Arrow hands to a task.

A word is a run of bytes other than space and 0x09-0x0D.  Hashes are Rabin-Karp polynomials modulo the prime
2**61 - 1 at points that a key decides; the hash of any span is read off prefix sums.  Two different spans of n values
agree for at most n of the 2**61 points, whatever the texts are, so an operator draws a new key for each run
(fresh_key) and hands it to its tasks.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of about this many bytes, which keeps the temporary arrays small.
SLICE_BYTES = (1 << 20) - 1024

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PRIME = (1 << 61) - 1
_P, _31, _30, _29, _32 = (_U((1 << bits) - 1) for bits in (61, 31, 30, 29, 32))
#: Bytes of a word that make one value of its polynomial; with their number it stays below the prime.
CHUNK = 7
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(CHUNK + 1)], _U)


def fresh_key() -> int:
    """A random key; the same for all tasks of a run."""
    return secrets.randbits(120)


#: For what is compared within one process only.
_OWN_KEY = fresh_key()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _reduced(s: np.ndarray) -> np.ndarray:
    s = (s & _P) + (s >> _U(61))
    return s - _P * (s >= _P)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of numbers below it."""
    a1, a0, b1, b0 = a >> _U(31), a & _31, b >> _U(31), b & _31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _30) << _U(31)) + a0 * b0)


class Point:
    """A point at which polynomials are taken, with as many of its powers and inverse powers as were needed."""

    def __init__(self, base: int):
        self.base = base % (PRIME - 2) + 2
        self.powers = [np.ones(1, _U), np.ones(1, _U)]

    def up_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[0]) < n:
            for k, b in enumerate((self.base, pow(self.base, -1, PRIME))):
                have = self.powers[k]
                while len(have) < n:
                    have = np.concatenate([have, times(have, np.full(1, pow(b, len(have), PRIME), _U))])
                self.powers[k] = have
        return self.powers[0][:n], self.powers[1][:n]


_points: dict[int, tuple[Point, Point]] = {}


def points(key: int) -> tuple[Point, Point]:
    """Points for the bytes of words and for words; a process keeps the powers of the last two keys."""
    if key not in _points:
        if len(_points) > 1:
            _points.pop(next(iter(_points)))
        _points[key] = Point(key & ((1 << 60) - 1)), Point(key >> 60)
    return _points[key]


def prefix(values: np.ndarray, point: Point) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i modulo the prime, as sums of their lower 32 and upper 29 bits."""
    terms = times(values, point.up_to(max(1, len(values)))[0][: len(values)])
    low, high = np.zeros(len(values) + 1, _U), np.zeros(len(values) + 1, _U)
    np.cumsum(terms & _32, out=low[1:])
    np.cumsum(terms >> _U(32), out=high[1:])
    return low, high


def span_value(sums: tuple[np.ndarray, np.ndarray], point: Point, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each span [start, end), alike wherever the span stands; below the prime."""
    low, high = (s[end] - s[start] for s in sums)
    total = (high >> _U(29)) + ((high & _29) << _U(32)) + (low & _P) + (low >> _U(61))
    return times(_reduced(total), point.up_to(max(1, len(sums[0])))[1][start])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets between them; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a slice of texts: byte spans, hashes, and for each text its range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE, key: int = _OWN_KEY):
        self.bytes_at, self.words_at = points(key)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        word = ~separators[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at = offsets[(offsets > 0) & (offsets < len(data))]
        first[at] = word[at]
        last[at - 1] = word[at - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: text i has the words [bounds[i], bounds[i + 1])
        self.bounds = np.searchsorted(self.start, offsets)
        self._value: np.ndarray | None = None
        self._sums: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def value(self) -> np.ndarray:
        """The polynomial of each word, over its bytes in values of up to CHUNK bytes and their number."""
        if self._value is None:
            size = self.end - self.start
            n = (size + CHUNK - 1) // CHUNK
            ends = np.cumsum(n)
            begins = ends - n
            place = CHUNK * (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(begins, n))
            filled = np.concatenate([self.data, np.zeros(8, np.uint8)])
            eight = np.ndarray((len(self.data) + 1,), "<u8", filled, strides=(1,))
            own = np.minimum(np.repeat(size, n) - place, CHUNK)
            chunks = (eight[np.repeat(self.start, n) + place] & _KEEP[own]) | (own.astype(_U) << _U(8 * CHUNK))
            self._value = span_value(prefix(chunks, self.bytes_at), self.bytes_at, begins, ends)
        return self._value

    @property
    def hash(self) -> np.ndarray:
        """The hash of each word, spread over 64 bits."""
        return mix(self.value)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The Rabin-Karp hash of each run of words [start, end)."""
        if self._sums is None:
            self._sums = prefix(self.value, self.words_at)
        return mix(span_value(self._sums, self.words_at, start, end))

    def window_starts(self, k: int) -> np.ndarray:
        """The first word of every window of k words inside one text."""
        n = np.maximum(self.counts - k + 1, 0)
        return np.arange(int(n.sum())) + np.repeat(self.bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every window of k words inside one text: its first word and its hash."""
        at = self.window_starts(k)
        return at, self.spans(at, at + k)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of texts of about `size` bytes (a longer text stands alone): first, end, bytes, offsets."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
