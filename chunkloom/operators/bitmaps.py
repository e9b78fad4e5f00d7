"""Compressed bitmaps over 32-bit ordinals (Lemire et al., "Roaring bitmaps", 2016), in numpy.

Ordinals are cut into spans of 65,536. A span with at most 4,096 members is a sorted uint16
array, a fuller one a bitset of 1,024 words.
"""

from __future__ import annotations

import numpy as np

SPAN_BITS = 16
ARRAY_MAX = 4096
WORDS = 1 << (SPAN_BITS - 6)


def _to_bits(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << SPAN_BITS, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _members(part: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint16:
        return part
    return np.flatnonzero(np.unpackbits(part.view(np.uint8), bitorder="little")).astype(np.uint16)


def _shrink(words: np.ndarray) -> np.ndarray | None:
    n = int(np.bitwise_count(words).sum())
    return None if n == 0 else _members(words) if n <= ARRAY_MAX else words


class Bitmap:
    """An immutable set of ordinals."""

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray]) -> None:
        self.parts = parts

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """From sorted distinct ordinals."""
        high = ordinals >> SPAN_BITS
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = {}
        for piece in np.split(ordinals, cuts) if len(ordinals) else ():
            low = (piece & 0xFFFF).astype(np.uint16)
            parts[int(piece[0] >> SPAN_BITS)] = low if len(low) <= ARRAY_MAX else _to_bits(low)
        return cls(parts)

    def __len__(self) -> int:
        return sum(len(p) if p.dtype == np.uint16 else int(np.bitwise_count(p).sum()) for p in self.parts.values())

    def ordinals(self) -> np.ndarray:
        found = [(_members(p).astype(np.int64) | (k << SPAN_BITS)) for k, p in sorted(self.parts.items())]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._combine(other, keep=False)

    def and_(self, other: Bitmap) -> Bitmap:
        return self._combine(other, keep=True)

    def _combine(self, other: Bitmap, *, keep: bool) -> Bitmap:
        out = {}
        for k, a in self.parts.items():
            b = other.parts.get(k)
            if b is None:
                part = None if keep else a
            elif a.dtype == np.uint16:
                if b.dtype == np.uint16:
                    inside = np.isin(a, b, assume_unique=True)
                else:
                    inside = (b[a >> 6] >> (a & np.uint16(63)).astype(np.uint64)) & np.uint64(1) == 1
                part = a[inside if keep else ~inside]
            else:
                words = b if b.dtype != np.uint16 else _to_bits(b)
                part = _shrink(a & words if keep else a & ~words)
            if part is not None and len(part):
                out[k] = part
        return Bitmap(out)
