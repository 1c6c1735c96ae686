"""Elias-Fano sequences and a two-level n-gram trie as flat levels that are read in place.

A trie is one run of bytes: a view on a buffer that a task received, or a memory-mapped file. Nothing is unpacked."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    place = np.zeros(len(words), np.uint64)
    k = k.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        w = np.uint64(width)
        ones = np.bitwise_count((words >> place) & ((_ONE << w) - _ONE)).astype(np.uint64)
        go = k >= ones
        k = np.where(go, k - ones, k)
        place = np.where(go, place + w, place)
    return place.astype(np.int64)


def flat(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each at a multiple of eight bytes, behind a head with their types and sizes."""
    head = [len(arrays)]
    for x in arrays:
        head += [x.dtype.itemsize, len(x)]
    out = [np.array(head, np.int64).tobytes()]
    for x in arrays:
        data = x.tobytes()
        out += [data, bytes(-len(data) % 8)]
    return b"".join(out)


def views(data: bytes | np.ndarray) -> list[np.ndarray]:
    """The arrays of ``flat``, as views."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    count = int(data[:8].view(np.int64)[0])
    head = data[8 : 8 + 16 * count].view(np.int64)
    at, out = 8 + 16 * count, []
    for size, n in head.reshape(-1, 2).tolist():
        out.append(data[at : at + size * n].view({1: np.uint8, 4: np.uint32, 8: np.uint64}[size]))
        at += -(-size * n // 8) * 8
    return out


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with a count of zeros per 64-bit word."""

    #: Arrays that make a sequence.
    ARRAYS = 4

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits = (int(x) for x in head)
        self.low, self.high, self.zeros = low, high, zeros

    @staticmethod
    def encoded(values: np.ndarray) -> list[np.ndarray]:
        """The arrays of a sequence of values that do not fall."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n, bits), np.uint8)
        for i in range(bits):
            low[:, i] = (values >> np.uint64(i)) & _ONE
        low = np.append(np.packbits(low.ravel(), bitorder="little"), np.zeros(16, np.uint8))
        high = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros((n + (top >> bits) + 2 + 63) // 64 * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        zeros = np.append(0, np.cumsum(64 - np.bitwise_count(words).astype(np.int64))[:-1]).astype(np.uint32)
        return [np.array([n, bits], np.uint64), low, words, zeros]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.bits
        first = bit >> 3
        out = np.zeros(len(at), np.uint64)
        for i in range(min(8, (self.bits + 7 + 7) // 8)):
            out |= self.low[first + i].astype(np.uint64) << np.uint64(8 * i)
        out >>= (bit & 7).astype(np.uint64)
        if self.bits > 57:  # a ninth byte holds the last bits
            ninth = self.low[first + 8].astype(np.uint64)
            back = np.uint64(64) - (bit & 7).astype(np.uint64)
            out |= np.where(back < 64, ninth << np.minimum(back, np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.bits) - 1)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have smaller high bits: the ones before the zero that ends the part before."""
        k = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        place = _select(~self.high[word], k - self.zeros[word]) + word * 64
        return np.where(high > 0, np.minimum(place - k, self.n), 0)

    def search(self, values: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """For each value, the place between ``lo`` and ``hi`` of the first one that is not smaller."""
        hi = self.n if hi is None else hi
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1])) - 1 if len(self.high) else 0
        over = high > last
        high = np.minimum(high, last)
        a, b = self._before(high), self._before(np.minimum(high + 1, last))
        a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        low = values & np.uint64((1 << self.bits) - 1)
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (self._lows(np.minimum(mid, max(self.n - 1, 0))) < low)
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return np.where(over, hi, a)

    def at(self, place: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, place, side="right") - 1
        bit = _select(np.asarray(self.high[word]), place - ones[word]) + word * 64
        return ((bit - place).astype(np.uint64) << np.uint64(self.bits)) | self._lows(place)


class Trie:
    """Words with their counts; contexts with a weight each and monotone pointers to their successors; a probability for each successor."""

    def __init__(self, data: bytes | np.ndarray) -> None:
        arrays = views(data)
        take = lambda i: EliasFano(*arrays[EliasFano.ARRAYS * i : EliasFano.ARRAYS * (i + 1)])
        self.words, self.sums, self.contexts, self.pointers, self.successors = map(take, range(5))
        self.low_bits, self.weights, self.codes = arrays[EliasFano.ARRAYS * 5 :]
        self.low_bits = self.low_bits[0]
        self.mask = (_ONE << self.low_bits) - _ONE

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie in a memory-mapped file."""
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def encoded(words: np.ndarray, counts: np.ndarray, keys: np.ndarray, codes: np.ndarray, weights: np.ndarray, low_bits: int) -> bytes:
        """``words`` with ``counts``; ``keys`` with ``codes``: sorted, the context above ``low_bits`` bits of the successor; a weight for each context."""
        contexts, first = np.unique(keys >> np.uint64(low_bits), return_index=True)
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(np.append(first, len(keys))))
        successors = (rank << np.uint64(low_bits)) | (keys & np.uint64((1 << low_bits) - 1))
        sequences = [words, np.cumsum(np.append(np.uint64(0), counts), dtype=np.uint64), contexts, np.append(first, len(keys)), successors]
        arrays = [a for x in sequences for a in EliasFano.encoded(x)]
        return flat([*arrays, np.array([low_bits], np.uint64), weights.astype(np.uint8), codes.astype(np.uint8)])

    def counts(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, 0 for those not held."""
        if not self.words.n or not len(words):
            return np.zeros(len(words), np.uint64)
        rank = np.minimum(self.words.search(words), self.words.n - 1)
        return np.where(self.words.at(rank) == words, self.sums.at(rank + 1) - self.sums.at(rank), np.uint64(0))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each sorted key and the weight of its context, 0 where they are not held."""
        out, weight = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        if not self.contexts.n or not len(keys):
            return out, weight
        asked, back = np.unique(keys >> self.low_bits, return_inverse=True)
        rank = np.minimum(self.contexts.search(asked), self.contexts.n - 1)
        held = self.contexts.at(rank) == asked
        lo, hi = self.pointers.at(rank).astype(np.int64), self.pointers.at(rank + 1).astype(np.int64)
        some = np.flatnonzero(held[back])
        back = back[some]
        weight[some] = self.weights[rank[back]]
        wanted = (rank[back].astype(np.uint64) << self.low_bits) | (keys[some] & self.mask)
        place = np.minimum(self.successors.search(wanted, lo[back], hi[back]), self.successors.n - 1)
        out[some] = np.where(self.successors.at(place) == wanted, self.codes[place], 0)
        return out, weight
