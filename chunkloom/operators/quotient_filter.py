"""Quotient filters (Bender et al., VLDB 2012) in the rank-and-select layout (Pandey et al., SIGMOD 2017).

A fingerprint of ``bits`` bits is split into a quotient (its high bits) and a remainder. The
remainders stand in one sorted array, byte-aligned; two bit vectors say which quotients occur
and where the run of each ends. Filters are immutable: sorted filters are merged into larger
ones, and a cascade of geometrically growing filters takes up a stream in bounded memory.
"""

from __future__ import annotations

import numpy as np

#: Bytes of metadata directory per 64 bits: the count of set bits before each word.
_ONE = np.uint64(1)


class _Bits:
    """A bit vector with rank and select."""

    __slots__ = ("before", "words")

    def __init__(self, positions: np.ndarray, size: int) -> None:
        words = np.zeros((size >> 6) + 1, dtype=np.uint64)
        np.bitwise_or.at(words, positions >> 6, _ONE << (positions & 63).astype(np.uint64))
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.uint32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE == _ONE

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[at >> 6].astype(np.int64) + np.bitwise_count(self.words[at >> 6] & mask)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit, from 0."""
        at = np.searchsorted(self.before, k, side="right") - 1
        left, word, base = (k - self.before[at]).astype(np.int64), self.words[at], np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            word = np.where(up, word >> np.uint64(width), word)
            base += np.where(up, width, 0)
        return (at.astype(np.int64) << 6) + base

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class QuotientFilter:
    """The set of fingerprints given, as quotients and remainders."""

    __slots__ = ("bits", "n", "occupied", "r", "remainders", "run_ends", "width")

    def __init__(self, fingerprints: np.ndarray, bits: int) -> None:
        """From sorted distinct fingerprints below ``2**bits``."""
        self.n, self.bits = len(fingerprints), bits
        q = min(bits, max(1, int(self.n).bit_length()))
        self.r = bits - q
        self.width = -(-self.r // 8)
        quotient = (fingerprints >> np.uint64(self.r)).astype(np.int64) if self.r < 64 else np.zeros(self.n, dtype=np.int64)
        self.remainders = np.ascontiguousarray(fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]) if self.n else np.empty((0, self.width), np.uint8)
        if self.r % 8 and self.width:
            self.remainders[:, -1] &= (1 << self.r % 8) - 1
        ends = np.flatnonzero(np.diff(quotient, append=-1) != 0)
        self.occupied = _Bits(quotient[ends], 1 << q)
        self.run_ends = _Bits(ends, max(self.n, 1))

    def _remainder(self, at: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), 8), dtype=np.uint8)
        wide[:, : self.width] = self.remainders[at]
        return wide.view("<u8").ravel()

    def fingerprints(self) -> np.ndarray:
        """All members, sorted."""
        at = np.arange(self.n, dtype=np.int64)
        words = self.occupied.words
        quotients = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype(np.uint64)
        return (quotients[self.run_ends.rank(at)] << np.uint64(self.r)) | self._remainder(at) if self.n else np.empty(0, np.uint64)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fingerprints), dtype=bool)
        if not self.n or not len(fingerprints):
            return found
        quotient = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        ask = np.flatnonzero(self.occupied.get(quotient))
        run = self.occupied.rank(quotient[ask])
        at = np.where(run > 0, self.run_ends.select(np.maximum(run - 1, 0)) + 1, 0)
        end = self.run_ends.select(run)
        want = fingerprints[ask] & np.uint64((1 << self.r) - 1)
        while len(ask):
            hit = self._remainder(at) == want
            found[ask[hit]] = True
            on = ~hit & (at < end)
            ask, at, end, want = ask[on], at[on] + 1, end[on], want[on]
        return found

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        both = np.concatenate((self.fingerprints(), other.fingerprints()))
        both.sort(kind="stable")
        return QuotientFilter(both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both, self.bits)

    @property
    def nbytes(self) -> int:
        return self.remainders.nbytes + self.occupied.nbytes + self.run_ends.nbytes


class Cascade:
    """Filters of falling size; a new one is merged with those not more than twice its size."""

    def __init__(self, bits: int) -> None:
        self.bits, self.levels = bits, []

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fingerprints), dtype=bool)
        for level in self.levels:
            left = np.flatnonzero(~found)
            found[left] = level.contains(fingerprints[left])
        return found

    def add(self, fingerprints: np.ndarray) -> None:
        """Take up sorted distinct fingerprints that are not members."""
        if len(fingerprints):
            new = QuotientFilter(fingerprints, self.bits)
            while self.levels and self.levels[-1].n <= 2 * new.n:
                new = self.levels.pop().merge(new)
            self.levels.append(new)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)


def fingerprint_bits(n_keys: int, wrong: float) -> int:
    """Bits with which ``n_keys`` keys give a new key a false match with probability ``wrong`` at most, however many."""
    return max(8, int(np.ceil(np.log2(max(n_keys, 1) / wrong))))


def mean_wrong(n_keys: int, bits: int) -> float:
    """Mean probability of a false match while a filter fills from none to ``n_keys`` keys."""
    x = n_keys * 2.0**-bits
    return 1 + float(np.expm1(-x)) / x if x > 1e-4 else x / 2
