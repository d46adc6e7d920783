"""A trigram trie: Elias-Fano pointers, prints of successors relative to their context, and quantised smoothed probabilities."""

from __future__ import annotations

import mmap
from dataclasses import dataclass

import numpy as np

_U64 = np.uint64
#: Bits of a word's print; two successors of one context share it once in 2**28.
PRINT_BITS = 28
#: A probability is one byte: 0 for none, else its place on a scale of so many steps a decade, rounded down, so that what is
#: stored never sums to more than what was counted.
STEPS = 32


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        place = np.ceil(-np.log10(p) * STEPS - 1e-9)
    return np.where(p > 0, 1 + np.clip(place, 0, 254), 0).astype(np.uint8)


_VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def dequantise(codes: np.ndarray) -> np.ndarray:
    return _VALUES[codes]


@dataclass
class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and how many ones stand before each word of those."""

    size: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(n * low_bits // 64 + 2, dtype=np.uint64)
        if low_bits and n:
            part = values & _U64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * _U64(low_bits)
            word, off = (bit >> _U64(6)).astype(np.int64), bit & _U64(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + _U64(low_bits) > _U64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U64(64) - off[over]))
        places = (values >> _U64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(universe >> low_bits) + n + 2) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, places >> 6, _U64(1) << (places & 63).astype(np.uint64))
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, low_bits, low, high, np.cumsum(counts) - counts)

    def at(self, k: np.ndarray) -> np.ndarray:
        """The values at places k."""
        word = np.searchsorted(self.ones, k, side="right") - 1
        bits, left, inner = self.high[word], k - self.ones[word], np.zeros(len(k), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((bits >> inner) & _U64((1 << half) - 1))
            past = here <= left
            left = left - here * past
            inner += past * _U64(half)
        return (word * 64 + inner.astype(np.int64) - k) << self.low_bits | self._lows(k)

    def _lows(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), dtype=np.int64)
        bit = k.astype(np.uint64) * _U64(self.low_bits)
        word, off = (bit >> _U64(6)).astype(np.int64), bit & _U64(63)
        second = np.where(off == 0, _U64(0), self.low[word + 1] << ((_U64(64) - off) & _U64(63)))
        return ((self.low[word] >> off | second) & _U64((1 << self.low_bits) - 1)).astype(np.int64)


@dataclass
class Level:
    """What hangs on the nodes above: for each node a range between two pointers, in it prints in order, and a code for each."""

    pointers: EliasFano
    prints: np.ndarray
    codes: np.ndarray

    @classmethod
    def build(cls, above: int, owner: np.ndarray, prints: np.ndarray, codes: np.ndarray) -> Level:
        """owner, the number of the node above of each entry, and prints within it are in order."""
        starts = np.searchsorted(owner, np.arange(above + 1))
        return cls(EliasFano.encode(starts, len(owner) + 1), prints.astype(np.uint32), codes)

    def search(self, node: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The place of each print among the successors of its node; -1 if it isn't there or the node is -1."""
        out = np.full(len(node), -1, dtype=np.int64)
        known = np.flatnonzero(node >= 0)
        low, end = self.pointers.at(node[known]), self.pointers.at(node[known] + 1)
        want, high = prints[known].astype(np.uint32), end.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = self.prints[middle] < want[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        inside = np.flatnonzero(low < end)
        inside = inside[self.prints[low[inside]] == want[inside]]
        out[known[inside]] = low[inside]
        return out

    def told(self, places: np.ndarray, none: float) -> np.ndarray:
        """The stored value at each place; none for -1."""
        out = np.full(len(places), none)
        found = places >= 0
        out[found] = dequantise(self.codes[places[found]])
        return out


class Trie:
    """Absolute discounting over words b, their successors c, their predecessors a, and the successors c of (a, b).

    Stored are the discounted share of c after b and after (a, b), and the weight that b and (a, b) leave to the order below.
    All levels lie in one anonymous memory map, which close() gives back.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray, c: np.ndarray, counts: np.ndarray, discount: float):
        """Counted trigrams, each once, in order of (b, a, c): 64-bit keys of b, prints of a and c."""
        new_b = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        new_ab = new_b | np.concatenate([[True], a[1:] != a[:-1]]) if len(b) else new_b
        at_b, at_ab = np.cumsum(new_b) - 1, np.cumsum(new_ab) - 1
        pair, of_pair = np.unique((at_b.astype(np.uint64) << _U64(PRINT_BITS)) | c.astype(np.uint64), return_inverse=True)
        pairs = np.bincount(of_pair, weights=counts, minlength=len(pair))
        pair_b = (pair >> _U64(PRINT_BITS)).astype(np.int64)
        self.words = b[new_b]
        n, m = len(self.words), int(new_ab.sum())
        self.totals, ab_totals = np.bincount(at_b, weights=counts, minlength=n), np.bincount(at_ab, weights=counts, minlength=m)
        self.left = quantise(discount * np.bincount(pair_b, minlength=n) / np.maximum(self.totals, 1))
        self.successors = Level.build(n, pair_b, pair & _U64((1 << PRINT_BITS) - 1), quantise((pairs - discount) / self.totals[pair_b]))
        self.contexts = Level.build(n, at_b[new_ab], a[new_ab], quantise(discount * np.bincount(at_ab, minlength=m) / np.maximum(ab_totals, 1)))
        self.trigrams = Level.build(m, at_ab, c, quantise((counts - discount) / ab_totals[at_ab]))
        self._map()

    def _parts(self):
        yield self, "words"
        yield self, "left"
        for level in (self.successors, self.contexts, self.trigrams):
            yield from ((level, "prints"), (level, "codes"), (level.pointers, "low"), (level.pointers, "high"), (level.pointers, "ones"))

    def _map(self) -> None:
        parts = [(owner, name, getattr(owner, name)) for owner, name in self._parts()]
        self._memory = mmap.mmap(-1, sum(p.nbytes + 8 for _, _, p in parts) + 8)
        at = 0
        for owner, name, part in parts:
            self._memory[at : at + part.nbytes] = part.tobytes()
            setattr(owner, name, np.frombuffer(self._memory, part.dtype, len(part), at))
            at += part.nbytes + -part.nbytes % 8

    def ask(self, b: np.ndarray, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each trigram the share that c has by (a, b) and b, and the weight that is left to c alone, as codes."""
        word = np.minimum(np.searchsorted(self.words, b), max(len(self.words) - 1, 0))
        word = np.where(self.words[word] == b, word, -1) if len(self.words) else np.full(len(b), -1)
        context = self.contexts.search(word, a)
        own = self.trigrams.told(self.trigrams.search(context, c), 0.0)
        after_b = self.successors.told(self.successors.search(word, c), 0.0)
        left_b = np.ones(len(b))
        left_b[word >= 0] = dequantise(self.left[word[word >= 0]])
        left_ab = self.contexts.told(context, 1.0)
        return quantise(own + left_ab * after_b), quantise(left_ab * left_b)

    def close(self) -> None:
        for owner, name in list(self._parts()):
            setattr(owner, name, None)
        self._memory.close()
