"""A three-level n-gram trie in Elias-Fano levels on one memory map.

Level 1 has the first words, level 2 for each of them the second words, level 3 for each pair the third words.  Monotone
pointers tell for each node of a level where its successors stand on the next one.  What is coded of a successor is its word
relative to its context: the word plus the last coded value before the context's range, so a level ascends although each
range begins anew, and its values grow by one word a context only.  A query takes the range of its context off the
pointers and searches the successor of that base plus the word from the range's beginning on; it must be equal and lie
within the range.  Probabilities are quantised.
"""

from __future__ import annotations

import mmap
import pickle

import numpy as np

from tidebook.llm import elias_fano

#: Codes per decade of a quantised probability; code 0 means absent.
STEPS = 4096

_U = np.uint64


def quantise(log10_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10_p * STEPS) + 1, 1, 65535).astype(np.uint16)


def log10_of(codes: np.ndarray) -> np.ndarray:
    return -(codes.astype(np.float64) - 1) / STEPS


def relative(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Ascending values of words that ascend within each of ascending contexts: each plus the last value before its context."""
    if not len(word):
        return word.astype(_U)
    last = np.flatnonzero(np.concatenate([context[1:] != context[:-1], [True]]))
    base = np.concatenate([[0], np.cumsum(word[last].astype(_U))]).astype(_U)
    return word + np.repeat(base[:-1], np.diff(np.concatenate([[-1], last])))


def build(first: np.ndarray, pairs: np.ndarray, pair_codes: np.ndarray, triples: np.ndarray, triple_codes: np.ndarray, bits: int) -> bytes:
    """The levels as bytes.

    first: ascending first words; pairs: ascending rank << bits | word; triples: ascending place of the pair << bits | word.
    """
    shift, low = _U(bits), _U((1 << bits) - 1)
    begins = np.searchsorted(pairs >> shift, np.arange(len(first) + 1, dtype=_U))
    thirds = np.searchsorted(triples >> shift, np.arange(len(pairs) + 1, dtype=_U))
    pairs, triples = relative(pairs >> shift, pairs & low), relative(triples >> shift, triples & low)
    heads, blobs, at = [], [], 0
    for values in (first, begins, pairs, thirds, triples):
        parts = elias_fano.encode(values)
        head = {"n": parts["n"], "width": parts["width"]}
        for name in ("low", "high", "ones", "zeros"):
            head[name] = (at, len(parts[name]))
            blobs.append(parts[name])
            at += len(parts[name])
        heads.append(head)
    for codes in (pair_codes, triple_codes):
        blob = codes.astype("<u2").tobytes()
        blob += b"\0" * (-len(blob) % 8)
        heads.append((at, 2 * len(codes)))
        blobs.append(blob)
        at += len(blob)
    head = pickle.dumps((bits, heads))
    head += b"\0" * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(blobs)


class Trie:
    """The levels of build(), mapped into memory and read in place."""

    def __init__(self, levels: bytes):
        self.map = mmap.mmap(-1, max(1, len(levels)))
        self.map.write(levels)
        view = memoryview(self.map)
        start = 8 + int.from_bytes(levels[:8], "little")
        self.bits, heads = pickle.loads(view[8:start])
        piece = lambda at: view[start + at[0] : start + at[0] + at[1]]
        levels_ = [elias_fano.Sequence({k: piece(v) if isinstance(v, tuple) else v for k, v in head.items()}) for head in heads[:5]]
        self.first, self.begins, self.pairs, self.thirds, self.triples = levels_
        self.pair_codes, self.triple_codes = (np.frombuffer(piece(h), "<u2") for h in heads[5:])

    def _ranges(self, pointers: elias_fano.Sequence, level: elias_fano.Sequence, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the successors of contexts begin and end on a level, and the value that theirs are relative to."""
        a, b = (pointers.at(context + i).astype(np.int64) for i in (0, 1))
        base = np.zeros(len(a), _U)
        after = np.flatnonzero(a > 0)
        base[after] = level.at(a[after] - 1)
        return a, b, base

    def _find(self, pointers: elias_fano.Sequence, level: elias_fano.Sequence, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each (context, word) on a level; -1 where the context is -1 or has no such word.  Contexts that
        stand side by side read their pointers once."""
        out = np.full(len(context), -1, np.int64)
        asked = np.flatnonzero(context >= 0)
        if not level.n or not len(asked):
            return out
        own = context[asked]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        times = np.diff(np.append(new, len(own)))
        a, b, base = (np.repeat(x, times) for x in self._ranges(pointers, level, own[new]))
        wanted = base + word[asked]
        place = np.maximum(level.successor(wanted), a)
        there = np.flatnonzero(place < b)
        there = there[level.at(place[there]) == wanted[there]]
        out[asked[there]] = place[there]
        return out

    def find_first(self, word: np.ndarray) -> np.ndarray:
        """The rank of each first word; -1 if it is absent."""
        place = self.first.successor(word)
        there = np.flatnonzero(place < self.first.n)
        there = there[self.first.at(place[there]) == word[there]]
        out = np.full(len(word), -1, np.int64)
        out[there] = place[there]
        return out

    def find_pair(self, rank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and code of each pair; -1 and 0 if it is absent."""
        place = self._find(self.begins, self.pairs, rank, word)
        return place, np.where(place >= 0, self.pair_codes[np.maximum(place, 0)] if self.pairs.n else 0, 0).astype(np.uint16)

    def find_triple(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each triple, given the place of its pair; 0 if it is absent."""
        place = self._find(self.thirds, self.triples, pair, word)
        return np.where(place >= 0, self.triple_codes[np.maximum(place, 0)] if self.triples.n else 0, 0).astype(np.uint16)

    def successors(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """The words after a first word, ascending, and their codes: a walk from one pointer to the next."""
        (a,), (b,), base = self._ranges(self.begins, self.pairs, np.array([rank]))
        return self.pairs.at(np.arange(a, b)) - base, self.pair_codes[a:b]
