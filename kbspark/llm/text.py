"""Vectorised text helpers for Arrow batches: words, hashes and shingle sets as numpy arrays.

A batch is cut into slices of about half a MB, whose bytes are worked on at once. Every whole text goes
into one slice, so a slice is as large as its longest text; memory is about 60 bytes a text byte.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES, SLICE_DOCS = 1 << 19, 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240917)
_MUL = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a block
LONG = 64  # bytes of a range beyond which it is hashed whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of the slices of a batch; a null text is empty."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + SLICE_DOCS, batch.num_rows)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives free memory back to the system when its task ends; workers live on between stages."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return out


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words of a slice; gap: which bytes lie between words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gap[data]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word ends where its text ends
    first[both] = True
    last[both] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, of one of eight independent families.

    Blocks of eight bytes go through ``mix`` one after the other; ranges of more than LONG bytes are hashed by BLAKE2b.
    """
    blocks = np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _MUL[family] + _MUL[family + 1])
    todo, at = np.flatnonzero(size <= LONG), 0
    while len(todo):
        left = size[todo] - at
        block = blocks[starts[todo] + at] & _MASK[np.minimum(left, 8)]
        out[todo] = mix(mix(out[todo] ^ block) + _MUL[family + 2])
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].data, digest_size=8, salt=bytes([family])).digest(), "little")
    return out


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles of each document, sorted by both.

    A document with fewer words than ``width``, but not none, has its whole sequence as one shingle.
    """
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    m = np.minimum(n, width)
    keep = np.arange(len(hashes)) - first[doc] < (n - m + 1)[doc]
    at, owner = np.flatnonzero(keep), doc[keep]
    size = m[owner]
    out = size.astype(np.uint64) * _MUL[15]
    for k in range(width):
        take = size > k
        out[take] += hashes[at[take] + k] * _MUL[k]
    out = mix(out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], owner[new]


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Per group, a 64-bit hash sum of 64-bit values; order does not matter."""
    low = np.bincount(group, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32)) + (high >> np.uint64(32)) * _MUL[14]


class Table:
    """Finds the rows of distinct, not negative 64-bit keys, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.size = 1 << max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.key, self.row = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32)
        keys = keys.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] == -1]
            at, which = np.unique(slot[free], return_index=True)
            self.key[at], self.row[at] = keys[free[which]], free[which]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slot(keys)
        seen = self.key[slot]
        out = np.where(seen == keys, self.row[slot], -1)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
            seen = self.key[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.row[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value a row of a two-dimensional byte array."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, max(w, 1), dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
