"""Elias-Fano sequences in numpy arrays that can be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of values one after another in 64-bit words, with a spare word."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        v = values & np.uint64((1 << bits) - 1)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, v << shift)
        over = (at & 63) + bits > 64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    at = at * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    high = np.where(shift > 0, words[word + 1] << (np.uint64(63) - shift + _ONE - (shift == 0)), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << bits) - 1)


_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_NTH = np.zeros((8, 256), np.uint8)  # place of the k-th set bit of a byte
for _b in range(256):
    for _k, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _NTH[_k, _b] = _p


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of words: its byte by running counts of set bits, then its place in the byte."""
    k = k.astype(np.uint64)
    s = x - ((x >> _ONE) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    at = np.bitwise_count((((k * _BYTES) | _TOPS) - s) & _TOPS).astype(np.uint64) * np.uint64(8)
    rank = k - (((s << np.uint64(8)) >> at) & np.uint64(255))
    return at.astype(np.int64) + _NTH[(rank & np.uint64(7)).astype(np.uint8), ((x >> at) & np.uint64(255)).astype(np.uint8)]


class EliasFano:
    """A non-decreasing sequence. ``arrays`` are its low bits, its high bits and the ones before each word of these."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((((top >> bits) + n + 2) // 64 + 2) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high[:-1]), dtype=np.int64)])
        return cls(n, bits, pack(values, bits), high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones.astype(np.uint32) if self.n < 1 << 32 else self.ones]

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | unpack(self.low, self.bits, i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _in_word(~self.high[word], k - self.zeros[word])

    def successor(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= target, n if there is none; whether it equals target).

        The high bits give the run of values that share the target's; their low bits are searched by halves,
        since the children of a frequent word lie close together.
        """
        h = (target >> np.uint64(self.bits)).astype(np.int64)
        low = target & np.uint64((1 << self.bits) - 1)
        over = h > int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1])) - 1
        h = np.where(over, 0, h)
        at = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0) - h
        end = self._zero(h) - h
        stop = end
        todo = np.flatnonzero(at < end)
        a, b, own = at[todo], end[todo], low[todo]
        while len(todo):
            mid = (a + b) >> 1
            less = unpack(self.low, self.bits, mid) < own
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            at[todo] = a
            more = a < b
            todo, a, b, own = todo[more], a[more], b[more], own[more]
        equal = np.zeros(len(h), bool)
        inside = np.flatnonzero((at < stop) & ~over)
        equal[inside] = unpack(self.low, self.bits, at[inside]) == low[inside]
        at[over] = self.n
        return at, equal
