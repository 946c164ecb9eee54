"""LM scoring by an Elias-Fano n-gram trie.

Level 1 holds the sorted 64-bit hashes of the training words with their counts; level k the k-grams, grouped
by their first k-1 words (the parent node). Of each level, monotone pointers say where a parent's children
begin, and the children's word ids are written relative to the last value before them, so that all of a level
is one non-decreasing sequence; both are Elias-Fano coded. Every node has a quantised smoothed
log-probability, and as a context a quantised back-off weight.

Spark counts: each task sums the n-grams of its documents and sends one packed row a shard; a shard is a
range of hashes, or of parents, merged by one task into files in the shared folder, which it moves into place
when they are whole, so that a task may run again. Shards of parents that very many tokens follow are summed by
several tasks first. Scoring tasks map the files of the levels and look up the
n-grams of many documents at once, sorted, by successor search in the parent's range. Counts cover all
training documents; nothing is pruned.

P_1(w) = (c+1) / (N+V+1); P_k(w|h) = max(c(hw)-D, 0) / c(h) + D t(h) / c(h) P_{k-1}(w|h'), where t(h) is the
number of words seen after h. An unseen n-gram has the weight of its context times the lower probability.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm import text as tx
from kbspark.llm.elias_fano import EliasFano
from kbspark.llm.stages import settle, shared_dir

DISCOUNT = 0.75
STEP = 12 / 65535  # of a quantised log10: 0 down to -12
SHARD_CHARS = 12 << 20  # characters of text a shard
END = tx.mix(np.array([0x656E64], np.uint64))[0]
BLOCK_BYTES = 6 << 20  # text whose n-grams are looked up at once
PER_SALT = 4 << 20  # tokens of a shard whose packets one task takes; there are about 2 million in a usual shard
KEPT_BYTES = 256 << 20  # of shards that are read, not mapped, which a worker keeps


# --- files -----------------------------------------------------------------------------------------------


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, 64-byte aligned; it appears when it is whole."""
    store, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    names = [(k, v.dtype.str, v.size) for k, v in arrays.items()]
    head = repr(names).encode().ljust(4096)
    with store.open_output_stream(part) as f:
        f.write(head)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes())
            f.write(b"\0" * (-v.nbytes % 64))
    store.move(part, path)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    import ast

    if urlparse(uri).scheme in ("", "file"):
        data = np.memmap(urlparse(uri).path, np.uint8, "r")
    else:
        store, path = filesystem(uri)
        with store.open_input_file(path) as f:
            data = np.frombuffer(f.read(), np.uint8)
    out, at = {}, 4096
    for k, kind, n in ast.literal_eval(data[:4096].tobytes().decode()):
        size = n * np.dtype(kind).itemsize
        out[k] = data[at : at + size].view(kind)
        at += size + -size % 64
    return out


def _ef(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    e = EliasFano.of(values)
    return {f"{name}.shape": np.array([e.n, e.bits]), **{f"{name}.{i}": a for i, a in enumerate(e.arrays())}}


def _as_ef(found: dict[str, np.ndarray], name: str) -> EliasFano:
    n, bits = (int(x) for x in found[f"{name}.shape"])
    return EliasFano(n, bits, np.asarray(found[f"{name}.0"]), np.asarray(found[f"{name}.1"]), found[f"{name}.2"].astype(np.int64))


def _order(x: np.ndarray) -> np.ndarray:
    """The order of whole numbers from 0; values with their places are sorted if both fit one word, which takes less time."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()) >= 1 << 63 - bits:
        return np.argsort(x)
    return np.sort((x.astype(np.int64) << bits) | np.arange(len(x))) & ((1 << bits) - 1)


# --- levels ----------------------------------------------------------------------------------------------


class Level:
    """The shards of a level. ``firsts``: the first key (hash or parent) of each, of
    ``span`` parents (0: hashes); ``offsets``: of its node ids."""

    def __init__(self, folder: str, k: int, names: list[int], firsts: list[int], sizes: list[int], span: int):
        self.folder, self.k, self.names, self.firsts, self.span = folder, k, names, np.array(firsts, np.uint64), span
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self._open: OrderedDict[int, dict] = OrderedDict()
        self._held = 0  # bytes of open shards that are not mapped

    def __getstate__(self):
        return self.__dict__ | {"_open": OrderedDict(), "_held": 0}

    def shard(self, s: int) -> dict:
        """The arrays of the s-th shard that has keys: mapped, or read and kept while there is room."""
        if s not in self._open:
            found = read_arrays(f"{self.folder}/level{self.k}-{self.names[s]}")
            size = sum(a.nbytes for a in found.values() if not isinstance(a, np.memmap))
            while self._open and self._held + size > KEPT_BYTES:
                self._held -= self._open.popitem(last=False)[1]["bytes"]
            self._held += size
            self._open[s] = found | {n: _as_ef(found, n) for n in ("keys", "pointers") if f"{n}.shape" in found} | {"bytes": size}
        self._open.move_to_end(s)
        return self._open[s]

    def _by_shard(self, sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if not len(self.firsts):
            return
        ends = np.concatenate([np.searchsorted(sorted_keys, self.firsts[1:].astype(sorted_keys.dtype)), [len(sorted_keys)]])
        at = 0
        for s, e in enumerate(ends):
            to = at + int(np.searchsorted(sorted_keys[at:e], int(self.firsts[s]) + self.span)) if self.span else int(e)
            if to > at:
                yield s, at, to
            at = int(e)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Level 1: ids of sorted hashes, -1 where a word is unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for s, a, b in self._by_shard(hashes):
            at, equal = self.shard(s)["keys"].successor(hashes[a:b] - self.firsts[s])
            out[a:b] = np.where(equal, at + self.offsets[s], -1)
        return out

    def children(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Nodes of (parent, word), sorted by parent; -1 where there is none."""
        out = np.full(len(parents), -1, np.int64)
        for s, a, b in self._by_shard(parents):
            found = self.shard(s)
            own = (parents[a:b] - int(self.firsts[s])).astype(np.int64)
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            group, each = np.cumsum(new) - 1, own[new]
            start, stop = found["pointers"].get(each).astype(np.int64), found["pointers"].get(each + 1).astype(np.int64)
            base = np.where(start > 0, found["keys"].get(np.maximum(start - 1, 0)), np.uint64(0))
            ok = (stop > start)[group]
            at, equal = found["keys"].successor(base[group[ok]] + words[a:b][ok].astype(np.uint64) + np.uint64(1))
            hit = equal & (at < stop[group[ok]])
            out[a:b][ok] = np.where(hit, at + self.offsets[s], -1)
        return out

    def values(self, name: str, nodes: np.ndarray) -> np.ndarray:
        """An array's values at node ids, in any order."""
        order = _order(nodes)
        at = nodes[order]
        got = None
        ends = np.searchsorted(at, self.offsets)
        for s in range(len(self.firsts)):
            a, b = int(ends[s]), int(ends[s + 1])
            if b > a:
                v = self.shard(s)[name][at[a:b] - self.offsets[s]]
                got = np.zeros(len(nodes), v.dtype) if got is None else got
                got[order[a:b]] = v
        return np.zeros(len(nodes)) if got is None else got

    def weights(self, parents: np.ndarray) -> np.ndarray:
        """Quantised back-off weights of parents (sorted not needed)."""
        order = _order(parents)
        got = np.zeros(len(parents), np.uint16)
        for s, a, b in self._by_shard(parents[order]):
            got[order[a:b]] = self.shard(s)["weight"][parents[order[a:b]] - int(self.firsts[s])]
        return got


class Trie:
    def __init__(self, order: int):
        self.order, self.levels, self.tokens, self.distinct = order, [], 0, 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        each, back = np.unique(hashes, return_inverse=True)
        return self.levels[0].words(each)[back]

    def nodes(self, ids: np.ndarray, head: np.ndarray, end: int, most: int) -> list[np.ndarray]:
        """For k up to ``most``: at each token, the node of the k-gram that ends there, -1 where there is none.

        head: tokens at which a text begins; the one before is taken to be the end of a text.
        """
        out = [ids]
        for k in range(2, most + 1):
            before = np.concatenate([[-1], out[-1][:-1]])
            before[head] = end if k == 2 else -1
            out.append(self.find(k, before, ids))
        return out

    def find(self, k: int, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        found = np.full(len(parents), -1, np.int64)
        ask = np.flatnonzero((parents >= 0) & (words >= 0))
        ask = ask[_order(parents[ask])]
        found[ask] = self.levels[k - 1].children(parents[ask], words[ask])
        return found

    def base(self, ids: np.ndarray) -> np.ndarray:
        c = np.zeros(len(ids))
        known = ids >= 0
        c[known] = self.levels[0].values("count", ids[known])
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def log10(self, ids: np.ndarray, head: np.ndarray, end: int, base: np.ndarray) -> np.ndarray:
        nodes = self.nodes(ids, head, end, self.order)
        out, done = base.copy(), np.zeros(len(ids), bool)
        for k in range(self.order, 1, -1):
            hit = ~done & (nodes[k - 1] >= 0)
            out[hit] -= base[hit] + self.levels[k - 1].values("logp", nodes[k - 1][hit]) * STEP
            done |= hit
            before = np.concatenate([[-1], nodes[k - 2][:-1]])
            before[head] = end if k == 2 else -1
            back = ~done & (before >= 0)
            out[back] -= self.levels[k - 1].weights(before[back]) * STEP
        return out


# --- counting --------------------------------------------------------------------------------------------


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document, heads) of the tokens of a slice: words, then the end of each text."""
    low = tx.LOWER[data]
    starts, ends, doc = tx.words(low, offsets, tx.SPACE)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n) + 1
    stop = np.cumsum(count)
    out = np.full(int(stop[-1]) if n else 0, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[stop - 1] = False
    out[inside] = tx.word_hashes(low, starts, ends)
    return out, np.repeat(np.arange(n), count), stop - count


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a block, hashes, document, heads): slices put together up to BLOCK_BYTES."""
    got, size = [], 0
    for batch in batches:
        for rows, data, offsets in tx.slices(batch, column):
            got.append((rows, *_tokens(data, offsets)))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield _joined(got)
                got, size = [], 0
    if got:
        yield _joined(got)


def _joined(got: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    docs = np.concatenate([[0], np.cumsum([g[0].num_rows for g in got])])
    place = np.concatenate([[0], np.cumsum([len(g[1]) for g in got])])
    return [g[0] for g in got], np.concatenate([g[1] for g in got]), np.concatenate([g[2] + d for g, d in zip(got, docs, strict=False)]), np.concatenate([g[3] + p for g, p in zip(got, place, strict=False)])


_PACKET = "shard int, salt int, a binary, b binary, c binary, n binary"


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, which the shuffle's compression makes smaller."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _steps(x: np.ndarray) -> np.ndarray:
    """A rising array as its first value and the steps from one to the next."""
    return np.concatenate([x[:1], x[1:] - x[:-1]])


def _packets(shard: np.ndarray, *arrays: np.ndarray, salt: int = 0, salts: dict[int, int] | None = None) -> pa.RecordBatch:
    """A row a shard, from arrays sorted by shard, the first of which rises within a shard; salts: of hot shards."""
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else np.array([0])
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays([pa.array([int(shard[i]) for i, _ in pairs], pa.int32()), pa.array([salt % (salts or {}).get(int(shard[i]), 1) for i, _ in pairs], pa.int32()), *(pa.array([_planes(a[i:j] if c else _steps(a[i:j])) for i, j in pairs], pa.binary()) for c, a in enumerate(arrays))], ["shard", "salt", "a", "b", "c", "n"])


def _salted(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks with a salt each, which depends on the task and on the place in it only."""
    from pyspark import TaskContext

    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7919
    for i, block in enumerate(blocks):
        yield first + i, *block


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _, _ in _blocks(batches, "text"):
            h, n = np.unique(hashes, return_counts=True)
            none = np.zeros(len(h), np.uint8)
            yield _packets((h >> np.uint64(64 - bits)).astype(np.int64), h, none, none, n.astype(np.uint32))

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict[str, list[bytes]]]]:
    """Of packets sorted by shard and salt, all of a pair."""
    last, got = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            here = row["shard"], row["salt"]
            if here != last:
                if last is not None:
                    yield last, got
                last, got = here, {c: [] for c in "abcn"}
            for c in "abcn":
                got[c].append(row[c])
    if last is not None:
        yield last, got


def _summed(shard: int, got: dict[str, list[bytes]], kinds: dict[str, type]) -> pa.RecordBatch:
    """One packet of all packets of a shard and salt; kinds: the types of a to c, whose n is summed."""
    keys = [_array(got[c], kind, c == "a") for c, kind in kinds.items()]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    n = np.add.reduceat(_array(got["n"], np.uint32)[order].astype(np.int64), at)
    if n.max() >= 1 << 32:
        raise OverflowError("an n-gram occurs 2**32 times")
    columns = dict(zip(kinds, keys, strict=True))
    none = np.zeros(len(at), np.uint8)
    return _packets(np.full(len(at), shard), *(columns[c][at] if c in columns else none for c in "abc"), n.astype(np.uint32))


def _array(parts: list[bytes], kind, rising: bool = False) -> np.ndarray:
    each = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for p in parts]
    return np.concatenate([np.cumsum(x, dtype=kind) for x in each] if rising else each)


_META = "shard int, size long, total long"


def _meta(shard: int, size: int, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([total], pa.int64())], ["shard", "size", "total"])


def _build_words(folder: str, bits: int):
    def build(shard: int, got: dict[str, list[bytes]]) -> pa.RecordBatch:
        keys, back = np.unique(_array(got["a"], np.uint64, True), return_inverse=True)
        n = np.bincount(back, _array(got["n"], np.uint32)).astype(np.int64)
        write_arrays(f"{folder}/level1-{shard}", {**_ef("keys", keys - (np.uint64(shard) << np.uint64(64 - bits))), "count": n.astype(np.uint32) if n.max() < 1 << 32 else n})
        return _meta(shard, len(keys), int(n.sum()))

    return build


def _loads(shipped, step: int):
    """Of numbers of shards of level 1: (shard, n), how many tokens the parents of shards of ``step`` parents have here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shipped.value[0].levels[0]
        for batch in batches:
            for s in batch.column(0).to_pylist():
                own = (level.offsets[s] + np.arange(level.offsets[s + 1] - level.offsets[s])) // step
                n = np.bincount(own - own[0], level.shard(s)["count"])
                yield pa.RecordBatch.from_arrays([pa.array((own[0] + np.arange(len(n))).astype(np.int32)), pa.array(n.astype(np.int64))], ["shard", "n"])

    return run


def _by_both(parent: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """The order by parent, then word, of which there are ``words``."""
    if not len(parent) or (int(parent.max()) + 1) * words < 1 << 63:
        return _order(parent * words + word)
    return np.lexsort((word, parent))


def _count_grams(shipped, k: int, shards: int, salts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, parents_n = shipped.value
        end = int(trie.ids(np.array([END]))[0])
        step = -(-parents_n // shards)
        for salt, _, hashes, _, head in _salted(_blocks(batches, "text")):
            nodes = trie.nodes(trie.ids(hashes), head, end, k - 1)
            parent = np.concatenate([[-1], nodes[-1][:-1]])
            parent[head] = end if k == 2 else -1
            use = parent >= 0
            parent, word, suffix = parent[use], nodes[0][use], nodes[-1][use]
            order = _by_both(parent, word, trie.distinct)
            parent, word, suffix = parent[order], word[order], suffix[order]
            new = np.ones(len(parent), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate([at, [len(parent)]])).astype(np.uint32)
            parent, word, suffix = parent[at], word[at], suffix[at]
            shard = parent // step
            yield _packets(shard, (parent - shard * step).astype(np.uint32), word.astype(np.uint32), trie.levels[k - 2].values("logp", suffix).astype(np.uint16) if k > 2 else np.zeros(len(at), np.uint8), n, salt=salt, salts=salts)

    return run


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def _build_grams(shipped, folder: str, k: int, shards: int):
    def build(shard: int, got: dict[str, list[bytes]]) -> pa.RecordBatch:
        trie, parents_n = shipped.value
        step = -(-parents_n // shards)
        parent, word, n = _array(got["a"], np.uint32, True).astype(np.int64), _array(got["b"], np.uint32).astype(np.int64), _array(got["n"], np.uint32)
        suffix = _array(got["c"], np.uint16) if k > 2 else word
        order = _by_both(parent, word, trie.distinct)
        parent, word, suffix, n = parent[order], word[order], suffix[order], n[order]
        new = np.ones(len(parent), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        n = np.add.reduceat(n.astype(np.int64), at)
        parent, word, suffix = parent[at], word[at], suffix[at]
        m = min(step, parents_n - shard * step)
        pointers = np.searchsorted(parent, np.arange(m + 1))
        total = np.bincount(parent, n, m)
        kinds = np.diff(pointers)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
        lower = 10.0 ** (trie.base(suffix) if k == 2 else suffix * -STEP)
        p = (n - DISCOUNT) / total[parent] + weight[parent] * lower
        # children relative to the last value before them, one up so that equal ids of two parents differ
        ends = pointers[1:][kinds > 0] - 1
        top = np.concatenate([[0], np.cumsum(word[ends] + 1)[:-1]]) if len(ends) else np.zeros(0, np.int64)
        values = word + 1 + np.repeat(top, kinds[kinds > 0])
        write_arrays(f"{folder}/level{k}-{shard}", {**_ef("keys", values), **_ef("pointers", pointers), "logp": _quantised(np.log10(p)), "weight": _quantised(np.log10(weight))})
        return _meta(shard, len(word), int(n.sum()))

    return build


_EITHER = f"{_META}, {_PACKET.removeprefix('shard int, ')}"


def _merged(packets: DataFrame, build, shards: int, kinds: dict[str, type], salts: dict[int, int]) -> list:
    """Build the files of a level; returns a row a shard. Packets of a hot shard, which has salts, are summed in a task a
    salt first, and one more builds from what is left, so that the words after a frequent one are in few packets."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, _), got in _shards(batches):
            yield build(shard, got)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, _), got in _shards(batches):
            if shard in salts:
                out = pa.Table.from_batches([_summed(shard, got, kinds)])
                empty = pa.nulls(1, pa.int64())
                out = out.append_column("size", empty).append_column("total", empty)
            else:
                out = pa.Table.from_batches([build(shard, got)])
                for c, kind in (("salt", pa.int32()), *((c, pa.binary()) for c in "abcn")):
                    out = out.append_column(c, pa.nulls(1, kind))
            yield from out.select(["shard", "size", "total", "salt", "a", "b", "c", "n"]).to_batches()

    if not salts:
        rows = packets.repartition(shards, "shard").sortWithinPartitions("shard", "salt")
        return rows.mapInArrow(built, _META).collect()  # a few numbers a shard
    rows = packets.repartition(shards + sum(salts.values()), "shard", "salt").sortWithinPartitions("shard", "salt")
    either = settle(rows.mapInArrow(first, _EITHER), "packets")
    hot = either.where("size is null").select("shard", F.lit(0).alias("salt"), "a", "b", "c", "n")
    rows = hot.repartition(len(salts), "shard").sortWithinPartitions("shard")
    return either.where("size is not null").select("shard", "size", "total").collect() + rows.mapInArrow(built, _META).collect()


def train(texts: DataFrame, order: int = 3) -> Trie:
    """A trie in the shared folder from all rows of texts(text)."""
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, chars / SHARD_CHARS)))))
    trie = Trie(order)
    found = {r["shard"]: r for r in _merged(texts.mapInArrow(_count_words(bits), _PACKET), _build_words(folder, bits), 1 << bits, {"a": np.uint64}, {})}
    here = sorted(found)
    if sum(r["size"] for r in found.values()) >= 1 << 32:
        raise OverflowError("there are 2**32 words")
    trie.tokens, trie.distinct = sum(r["total"] for r in found.values()), sum(r["size"] for r in found.values())
    trie.levels.append(Level(folder, 1, here, [s << (64 - bits) for s in here], [found[s]["size"] for s in here], 0))
    for k in range(2, order + 1):
        n, shards = int(trie.levels[-1].offsets[-1]), 1 << bits
        shipped = spark.sparkContext.broadcast((trie, n))  # names and sizes of shards
        step = -(-n // shards) if n else 1
        salts = {}
        if k > 2 and n:  # about as many tokens follow the parents of a shard as they have themselves, which their own shards tell
            tokens = np.interp(np.arange(shards + 1) * step, trie.levels[-1].offsets, np.concatenate([[0], np.cumsum([built[s]["total"] for s in here])]))
            salts = {s: int(-(-x // PER_SALT)) for s, x in enumerate(np.diff(tokens)) if x > PER_SALT}
        if k == 2 and n:  # how many tokens follow the parents of a shard is known from the counts of words
            loads = spark.range(len(trie.levels[0].names)).mapInArrow(_loads(shipped, step), "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
            salts = {r["shard"]: -(-r["n"] // PER_SALT) for r in loads.where(F.col("n") > PER_SALT).collect()}  # a number a shard
        packets = texts.mapInArrow(_count_grams(shipped, k, shards, salts), _PACKET)
        built = {r["shard"]: r for r in _merged(packets, _build_grams(shipped, folder, k, shards), shards, {"a": np.uint32, "b": np.uint32} if k == 2 else {"a": np.uint32, "b": np.uint32, "c": np.uint16}, salts)} if n else {}
        here = sorted(built)
        trie.levels.append(Level(folder, k, here, [s * step for s in here], [built[s]["size"] for s in here], step))
    return trie


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shipped.value
        end = int(trie.ids(np.array([END]))[0])
        for rows, hashes, doc, head in _blocks(batches, "text"):
            ids = trie.ids(hashes)
            base = trie.base(ids)
            score = trie.log10(ids, head, end, base)
            t = pa.Table.from_batches(rows)
            d = t.num_rows
            n, known = np.bincount(doc, minlength=d), np.bincount(doc[ids >= 0], minlength=d)
            out = pa.table([t["doc_id"], t["held_out"], pa.array(n), pa.array(known), pa.array(np.full(d, trie.tokens)), pa.array(np.bincount(doc, base, d)), pa.array(np.bincount(doc, score, d))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            yield from out.combine_chunks().to_batches()

    return run


def score(docs: DataFrame, held_out: Column, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Learns from all rows that are not held out. Tokens: words between white space after lower-casing A-Z, then
    one end; a null text is empty, so it is one end. base_score: add-one unigrams. Without training rows, N
    and V are 0. Repeated rows are counted, and scored, each time; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    trie = train(rows.where("not held_out").select("text"), order)
    shipped = docs.sparkSession.sparkContext.broadcast(trie)
    return rows.mapInArrow(_score(shipped), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
