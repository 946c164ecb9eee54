"""Ranked lexical search: an inverted index in compressed blocks, searched by Block-Max MaxScore.

Tasks index shards of documents. A shard has one row a term, with the postings in blocks of BLOCK documents as variable
bytes and, outside of them, the first and last document and the largest impact of each block, and one row with
the ids and length terms of its documents. The impact of a posting is the part of its score that does not depend
on the query, so block maxima are exact; N and L are counted before.

A task searches its shards one after the other and keeps the best documents of each query in a heap that all
of them share. The terms of a query are added from the largest bound down until the bounds of the others sum to less
than the heap's last score: those lists are not essential. Documents that no essential list holds are never
looked at; for the rest, the maxima of the blocks where they would be in the other lists are added, and only blocks of
documents that could still enter the heap are decompressed. A first job over a few shards gives all tasks a score to
start from. Heaps are merged by a window. All scores are integers, so the result is exact, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.stages import partitions, settle, sized
from kbspark.llm.text import LOWER, SLICE_BYTES, slices, tidy, words

BLOCK = 128
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
SEED_SHARDS = 8  # searched first, for a score that the others start from
QUERY_TERMS = 500_000  # of the queries that are sent to tasks at once; more queries are searched in several jobs

#: Bytes between terms of the rule [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
GAP = np.zeros(256, bool)
GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, offsets) of slices; a text longer than a slice comes in several, cut between terms."""
    row = 0
    for part, data, offsets in slices(batch):
        if part.num_rows > 1 or len(data) <= 2 * SLICE_BYTES:
            yield row, data, offsets
        else:
            at = 0
            while at < len(data):
                end = min(at + SLICE_BYTES, len(data))
                while end < len(data) and not GAP[data[end]]:
                    end += 1
                yield row, data[at:end], np.array([0, end - at])
                at = end
        row += part.num_rows


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms as a binary array, and the text of each."""
    low = LOWER[data]
    starts, ends, doc = words(low, offsets, GAP)
    body = low[~GAP[low]]  # terms have no gaps between them here
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(body))]), doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for row, data, offsets in _pieces(batch):
            doc = words(LOWER[data], offsets, GAP)[2]
            np.add.at(sizes, row + doc, 1)
        n, total = n + int(np.count_nonzero(sizes)), total + int(sizes.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with at least one term, and L, all terms with repeats, of docs(text)."""
    return tuple(docs.select("text").mapInArrow(tidy(_count), "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())


def var_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Not negative integers, seven bits a byte with the lowest first; and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        size += rest > 0
        rest = rest >> 7
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = size[has] > k + 1
        out[at[has] + k] = ((values[has] >> (7 * k)) & 127) | (more << 7)
    return out, size


def from_var_bytes(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int(size.max(initial=0))):
        has = size > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Shard:
    """Gathers postings of a shard's documents."""

    def __init__(self, block: int):
        self.ids, self.sizes, self.words, self.parts, self.bytes, self.block = [], [], [], [], 0, block

    def add(self, ids: pa.Array) -> int:
        first = len(self.sizes)
        self.ids += ids.to_pylist()
        self.sizes += [0] * len(ids)
        return first

    def take(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        terms, doc = _terms(data, offsets)
        self.bytes += len(data)
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        n = len(offsets) - 1
        pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
        for k, c in enumerate(np.bincount(doc, minlength=n)):
            self.sizes[first + k] += int(c)
        self.parts.append((pair // n, pair % n + first, tf))
        self.words.append(coded.dictionary)

    def rows(self, name: int, n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
        m = 50 + (50 * np.array(self.sizes, np.int64) * n_docs) // max(total, 1)
        yield _batch([name], [None], [len(m)], [m.tobytes()], [b""], [self.ids])
        if not self.parts:
            return
        coded = pa.concat_arrays(self.words).dictionary_encode()
        code, at = coded.indices.to_numpy().astype(np.int64), 0
        codes = []
        for words_, (own, _, _) in zip(self.words, self.parts, strict=True):
            codes.append(code[at + own])
            at += len(words_)
        code, doc, tf = np.concatenate(codes), np.concatenate([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts])
        pair = code * len(m) + doc
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))  # a text in several pieces has its counts added
        tf = np.add.reduceat(tf[order], first)
        code, doc = code[order][first], doc[order][first]
        begin = np.flatnonzero(np.diff(code, prepend=-1))  # of lists
        length = np.diff(begin, append=len(code))
        rank = np.arange(len(code)) - np.repeat(begin, length)
        opens = np.flatnonzero(rank % self.block == 0)
        closes = np.append(opens[1:], len(code)) - 1
        gap = np.diff(doc, prepend=0)
        gap[opens] = 0
        data, size = var_bytes(np.column_stack([gap, tf]).ravel())
        end = np.cumsum(size)[1::2]  # of the bytes of each posting
        data_from = np.concatenate([[0], end[begin[1:] - 1]])  # of each list
        list_of = np.searchsorted(begin, opens, "right") - 1
        heads = np.column_stack([doc[opens], doc[closes], np.maximum.reduceat(impacts(tf, m[doc]), opens), end[closes] - data_from[list_of]]).astype(np.uint32)
        heads_from = np.append(np.searchsorted(opens, begin), len(opens))
        data_to = np.append(data_from[1:], len(data))
        names = coded.dictionary.take(pa.array(code[begin])).cast(pa.binary())
        for s in range(0, len(begin), 4096):
            k = range(s, min(s + 4096, len(begin)))
            yield _batch([name] * len(k), names.slice(s, len(k)), length[s : s + len(k)], [data[data_from[i] : data_to[i]].tobytes() for i in k], [heads[heads_from[i] : heads_from[i + 1]].tobytes() for i in k], [None] * len(k))


def _batch(shard, term, df, data, heads, ids) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    columns = (shard, term, df, data, heads, ids)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "term", "df", "data", "heads", "ids"])


def _indexer(n_docs: int, total: int, shard_docs: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = TaskContext.get().partitionId() << 32, _Shard(block)
        for batch in batches:
            ids, added, first = batch.column(0), 0, 0
            for row, data, offsets in _pieces(batch):
                upto = row + len(offsets) - 1
                if upto > added:  # not the next piece of the same text
                    if len(shard.sizes) >= shard_docs or shard.bytes >= SHARD_BYTES:
                        yield from shard.rows(name, n_docs, total)
                        name, shard = name + 1, _Shard(block)
                    first = shard.add(ids.slice(row, upto - row))
                    added = upto
                shard.take(first, data, offsets)
        if shard.sizes:
            yield from shard.rows(name, n_docs, total)

    return run


@dataclass
class Index:
    lists: DataFrame  # shard, term, df, data, heads, ids
    n: int
    total: int


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, block: int = BLOCK) -> Index:
    """The index of every row of docs(doc_id, text), as a table of the shared folder.

    A shard is closed after so many documents or SHARD_BYTES, and has those of one slice more at most.
    A null text has no terms; such documents are never found. Null ids stay, repeated rows are documents of their own.
    """
    n, total = corpus_counts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Index(settle(rows.mapInArrow(tidy(_indexer(n, total, shard_docs, block)), "shard long, term binary, df long, data binary, heads binary, ids array<long>"), "postings"), n, total)


@dataclass
class _List:
    """A term's postings in a shard; blocks are decompressed when they are asked for."""

    heads: np.ndarray
    data: np.ndarray
    m: np.ndarray
    tally: dict
    docs: np.ndarray | None = None
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def decompress(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of blocks, in order."""
        ends = self.heads[:, 3].astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        parts = [self.data[starts[b] : ends[b]] for b in which]
        self.tally["blocks"] += len(which)
        pairs = from_var_bytes(np.concatenate(parts)).reshape(-1, 2)
        opens = which * 0
        opens[1:] = np.cumsum([np.count_nonzero(p < 128) // 2 for p in parts[:-1]])
        docs = np.cumsum(pairs[:, 0])
        length = np.diff(opens, append=len(docs))
        docs += np.repeat(self.heads[which, 0].astype(np.int64) - docs[opens], length)
        return docs, impacts(pairs[:, 1], self.m[docs])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.docs is None:
            self.docs, self.impact = self.decompress(np.arange(len(self.heads)))
        return self.docs, self.impact

    def find(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of documents, each looked for in its block only; 0 where it is not."""
        if self.docs is None:
            need = np.unique(block)
            new = np.array([b for b in need if b not in self.blocks], np.int64)
            if len(new):
                d, i = self.decompress(new)
                cut = np.searchsorted(d, self.heads[new[1:], 0])
                for b, x, y in zip(new, np.split(d, cut), np.split(i, cut), strict=True):
                    self.blocks[int(b)] = x, y
            own, impact = (np.concatenate([self.blocks[int(b)][k] for b in need]) for k in (0, 1))
        else:
            own, impact = self.docs, self.impact
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, impact[at], 0)


class Heap:
    """The best documents of a query: highest scores, of equal ones the smallest ids, null ids last."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor = k, floor
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """No document that scores less can enter."""
        return max(self.floor, int(self.score[-1]) if len(self.score) == self.k else 0)

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least()
        score, id_, null = np.append(self.score, score[keep]), np.append(self.id, id_[keep]), np.append(self.null, null[keep])
        order = np.lexsort((id_, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], id_[order], null[order]


def _at_least(score: np.ndarray, heap: Heap) -> int:
    """A score that k documents of the heap and of partial scores reach, or the heap's least."""
    least = heap.least()
    score = score[score > least]
    if len(score) < heap.k:
        score = np.append(score, heap.score)
    return max(least, int(np.partition(score, len(score) - heap.k)[len(score) - heap.k])) if len(score) >= heap.k else least


def search_shard(query: list[tuple[bytes, int]], lists: dict[bytes, _List], ids: np.ndarray, null: np.ndarray, heap: Heap) -> None:
    """Enter the best documents of a shard into the heap of a query, given as terms and weights."""
    own = sorted(((w * int(lists[t].heads[:, 2].max()), w, lists[t]) for t, w in query if w > 0 and t in lists), key=lambda x: -x[0])
    rest = np.append(np.cumsum([x[0] for x in own][::-1])[::-1], 0)  # bounds of a list and all after it
    if not own or rest[0] < heap.least():
        return
    score, least, k = np.zeros(len(ids), np.int64), heap.least(), 0
    while k < len(own) and rest[k] >= least:  # essential lists
        docs, impact = own[k][2].all()
        score[docs] += own[k][1] * impact
        k += 1
        if k < len(own):
            least = _at_least(score, heap)
    found = np.flatnonzero((score > 0) & (score + rest[k] >= least))
    score = score[found]
    places, bounds = [], []
    upper = score.copy()
    for _, w, postings in own[k:]:
        block = np.searchsorted(postings.heads[:, 0], found, "right") - 1
        inside = (block >= 0) & (found <= postings.heads[block, 1])
        bound = np.where(inside, w * postings.heads[block, 2].astype(np.int64), 0)
        places.append(block)
        bounds.append(bound)
        upper += bound
    alive = np.flatnonzero(upper >= least)
    for (_, w, postings), block, bound in zip(own[k:], places, bounds, strict=True):
        look = alive[bound[alive] > 0]
        if len(look):
            upper[look] += w * postings.find(found[look], block[look]) - bound[look]
            alive = alive[upper[alive] >= least]
    heap.add(upper[alive], ids[found[alive]], null[found[alive]])


def _searcher(queries: list[tuple[int, list[tuple[bytes, int]], int]], k: int):
    """queries: number, terms with weights, and the score to start from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {q: Heap(k, floor) for q, _, floor in queries}
        tally = {"blocks": 0, "all": 0}
        shard, m, ids, null, lists = None, None, None, None, {}

        def search() -> None:
            tally["all"] += sum(len(x.heads) for x in lists.values())
            for q, terms, _ in queries:
                search_shard(terms, lists, ids, null, heaps[q])
            lists.clear()

        for batch in batches:
            for name, term, data, heads, own_ids in zip(*(batch.column(c) for c in ("shard", "term", "data", "heads", "ids")), strict=True):
                if name.as_py() != shard:
                    search()
                    shard = name.as_py()
                if not term.is_valid:  # comes first in its shard
                    m = np.frombuffer(data.as_py(), np.int64)
                    null = own_ids.values.is_null().to_numpy(zero_copy_only=False)
                    ids = own_ids.values.fill_null(0).to_numpy()
                else:
                    lists[term.as_py()] = _List(np.frombuffer(heads.as_py(), np.uint32).reshape(-1, 4), np.frombuffer(data.as_py(), np.uint8), m, tally)
        search()
        for q, heap in heaps.items():
            n = len(heap.score)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), pa.array(heap.id, mask=heap.null), pa.array(heap.score)], ["q", "doc_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([tally["blocks"]], pa.int64()), pa.array([tally["all"]], pa.int64())], ["q", "doc_id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in _pieces(batch):
            terms, doc = _terms(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + doc)), batch.column(1).take(pa.array(row + doc)), terms.cast(pa.binary())], ["q", "item_id", "term"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of items(item_id, text), with a score above 0.

    Equal scores by ascending doc_id, null ids last. Items without a term, or of which no term occurs, have no rows; rows
    that repeat an item are items of their own.
    """
    found = _search(index, items, k)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.where("q >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def blocks_read(index: Index, items: DataFrame, k: int = 50) -> tuple[int, int]:
    """Blocks that the search decompresses, and all blocks of the lists of its terms."""
    return tuple(_search(index, items, k).where("q < 0").agg(F.sum("doc_id"), F.sum("score")).first())


def _search(index: Index, items: DataFrame, k: int) -> DataFrame:
    spark = items.sparkSession
    rows = settle(items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id"), "text"), "queries")
    kind = dict(rows.dtypes)["item_id"]
    terms = settle(rows.mapInArrow(tidy(_query_terms), f"q long, item_id {kind}, term binary").distinct(), "query-terms")
    jobs = max(1, -(-terms.count() // QUERY_TERMS))
    out = None
    for job in range(jobs):
        asked = terms.where(F.pmod(F.xxhash64("q"), F.lit(jobs)) == job)
        known = sized(asked.select("term").distinct())
        part = settle(index.lists.join(known, "term", "left_semi").unionByName(index.lists.where("term is null")), "query-lists")
        df = part.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for r in asked.join(df, "term").select("q", "term", "df").collect():  # at most QUERY_TERMS, or one item
            queries.setdefault(r["q"], []).append((bytes(r["term"]), weight(index.n, r["df"])))

        def run(lists: DataFrame, floor: dict[int, int], queries=queries) -> DataFrame:
            dealt = lists.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
            asks = [(q, terms, floor.get(q, 1)) for q, terms in queries.items()]
            return dealt.select("shard", "term", "data", "heads", "ids").mapInArrow(tidy(_searcher(asks, k)), "q long, doc_id long, score long")

        few = [r["shard"] for r in part.where("term is null").select("shard").orderBy(F.xxhash64("shard")).limit(SEED_SHARDS).collect()]
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        seeds = run(part.where(F.col("shard").isin(few)), {}).where("q >= 0").withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
        floor = {r["q"]: r["score"] for r in seeds.select("q", "score").collect()}
        got = run(part, floor)
        out = got if out is None else out.unionByName(got)
    return settle(out, "found").join(sized(rows.select("q", "item_id")), "q", "left")
