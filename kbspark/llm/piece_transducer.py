"""SentencePiece encoding and decoding by a weighted transducer.

A model is compiled to a transducer: the normaliser rewrites characters, arcs read the characters of a piece
and write its id at the cost of minus its score, and a character that no piece covers is written as its
UTF-8 bytes. Composed with an input, this is a lattice over the input's positions, whose shortest path in the
tropical semiring (least sum of costs) is the encoding.

For a byte-pair model, states carry the last piece, and an arc leaves a state only if merging the characters of
both pieces gives back just these two. A sequence of pieces is the merge encoding of its text exactly if all
neighbours may follow one another, so one path is left for every prefix. Whether two pieces may follow is
read from the ranks of the merges on both sides of their seam. A unigram model has no such restriction.

No piece reaches over a pair of characters that is inside no piece, so inputs are cut there, and words recur.
The new words of many documents are composed and relaxed together in arrays; each worker keeps the paths of
words it meets again (a bounded memory).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import text as tx

MARK = "▁"  # fixed value: written for a blank
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_KEPT = 100_000  # words whose paths a worker keeps, about, and as many older ones
NEVER = 1 << 30  # later than any merge
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5  # fixed values: kinds of pieces


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    """Symbols are the pieces, by id, then the characters that are in pieces but are none, then one for all other
    characters. A symbol without a piece id is written by byte fallback, or as unknown, at the cost of ``low``."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, prefix: bool = True, fold: bool = False):
        self.kind, self.prefix, self.fold = kind, prefix, fold
        self.names = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.score = [s for _, s, _ in pieces]
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.low = min((self.score[i] for i in self.id.values()), default=0.0) - 10
        # blanks begin words, controls that no piece holds stand alone
        alone = "".join(re.escape(chr(c)) for c in range(32) if not any(chr(c) in p for p in self.id))
        joins = any(MARK in p.lstrip(MARK) for p in self.id)
        self.cut = re.compile("(?s).+") if joins else re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self._compile()
        self._forget()

    def _compile(self) -> None:
        v = len(self.names)
        chars = sorted({c for p in self.id for c in p})
        self.number = {c: i + 1 for i, c in enumerate(chars)}  # 0: every other character
        self.width = len(chars) + 1
        extra = [c for c in chars if c not in self.id]
        symbol = self.id | {c: v + i for i, c in enumerate(extra)}
        self.symbols = v + len(extra) + 1
        self.cost = np.array([-s for s in self.score] + [-self.low] * (len(extra) + 1))
        self.single = np.array([self.symbols - 1, *(-1 if c in self.id else symbol[c] for c in chars)])  # arcs of characters that are no piece
        levels = {s: i for i, s in enumerate(sorted({-self.score[i] for i in self.id.values()}))}
        rank = {i: levels[-self.score[i]] for i in self.id.values()}
        pairs = {(symbol[p[:k]], symbol[p[k:]]): i for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol} if self.kind == BPE else {}
        # of each symbol, what its merges leave in turn: the first and the last symbol, and the rank of the next merge
        first, last, wait, self.state = [], [], [], np.zeros(self.symbols + 1, np.int64)
        whole = set()
        names = dict(enumerate(self.names)) | {s: c for c, s in symbol.items()}
        for s in range(self.symbols):
            self.state[s] = len(first)
            name = names.get(s, "?") if symbol.get(names.get(s)) == s else "?"
            steps, end = _merges([symbol[c] for c in name], pairs, rank) if name != "?" and self.kind == BPE else ([(s, s, NEVER)], [s])
            if end == [s]:
                whole.add(s)
            else:
                steps = [(s, s, NEVER)]
            for f, t, w in steps:
                first.append(f)
                last.append(t)
                wait.append(w)
        self.state[-1] = len(first)
        self.first, self.last, self.wait = (np.array(x, np.int32) for x in (first, last, wait))
        self.pairs, self.pair_rank = tx.Table(np.array([a * self.symbols + b for a, b in pairs], np.int64)), np.array([rank[i] for i in pairs.values()], np.int32)
        # the tree of the pieces: an arc from node to node reads a character, final nodes write a piece
        arcs: dict[tuple[int, int], int] = {}
        final, inside = [-1], set()
        for p, i in self.id.items():
            if i in whole:
                node = 0
                for c in map(self.number.__getitem__, p):
                    if (node, c) not in arcs:
                        arcs[node, c] = len(final)
                        final.append(-1)
                    node = arcs[node, c]
                final[node] = i
                inside.update((self.number[a], self.number[b]) for a, b in zip(p, p[1:], strict=False))
        self.final, self.child = np.array(final, np.int32), np.fromiter(arcs.values(), np.int32, len(arcs))
        self.arcs = tx.Table(np.array([n * self.width + c for n, c in arcs], np.int64))
        self.inside = tx.Table(np.array([a * self.width + b for a, b in inside], np.int64))
        self.known, self.answer, self.fresh = tx.Table(np.zeros(0, np.int64)), np.zeros(0, bool), []

    @classmethod
    def read(cls, data: bytes) -> Transducer:
        """A model file's transducer. Only identity normalisers are known; others have a character map."""
        pieces, kind, prefix, fold = [], UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("the model's normaliser has a character map, which is not supported")
                prefix, fold = bool(f.get(3, 1)), bool(f.get(4, 1))
        return cls(pieces, kind, prefix, fold)

    def normalise(self, text: str) -> str:
        """The text as the normaliser writes it: a transducer that rewrites blanks, and reads runs of them as one where it folds."""
        if self.fold:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    @cached_property
    def code(self) -> np.ndarray:
        """The number of every code point."""
        out = np.zeros(0x110000, np.uint16 if self.width < 1 << 16 else np.int32)
        for c, i in self.number.items():
            out[ord(c)] = i
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("code", "rows", "pool", "ends", "uses")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.rows, self.pool, self.ends, self.uses = {}, np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def compose(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, symbol) of the arcs of the lattice over numbered characters; no arc passes ``stop`` of its start."""
        at, node, n = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        out = []
        while len(at):
            row = self.arcs.find(node * self.width + chars[at + n])
            ok = row >= 0
            at, node, n = at[ok], self.child[row[ok]].astype(np.int64), n + 1
            hit = self.final[node] >= 0
            out.append((at[hit], np.full(int(hit.sum()), n), self.final[node[hit]].astype(np.int64)))
            ok = at + n < stop[at]
            at, node = at[ok], node[ok]
        own = self.single[chars]
        at = np.flatnonzero(own >= 0)
        out.append((at, np.ones(len(at), np.int64), own[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether symbol b may follow symbol a, for each pair."""
        key = a * self.symbols + b
        row = self.known.find(key)
        ok = np.zeros(len(key), bool)
        ok[row >= 0] = self.answer[row[row >= 0]]
        new = np.flatnonzero(row < 0)
        if len(new):
            each, back = np.unique(key[new], return_inverse=True)
            got = self._seam(each // self.symbols, each % self.symbols)
            ok[new] = got[back]
            self.fresh.append((each, got))
        return ok

    def _seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the seam of a and b when both are merged from their characters: whichever side
        has the better merge goes first, the left one of equals, unless the pair at the seam is better."""
        i, j = self.state[a], self.state[b]
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            row = self.pairs.find(self.last[i].astype(np.int64) * self.symbols + self.first[j])
            across = np.full(len(live), NEVER)
            across[row >= 0] = self.pair_rank[row[row >= 0]]
            x, y = self.wait[i], self.wait[j]
            fires = (across < x) & (across <= y) & (across < NEVER)
            out[live[fires]] = False
            left = x <= y
            go = ~fires & ((x < NEVER) | (y < NEVER))
            i, j, live = (i + left)[go], (j + ~left)[go], live[go]
        return out

    def shortest(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, symbol) of the arcs on the shortest paths over parts of numbered characters that end at ``ends``.

        All parts at once, one distance from their beginnings after the other: the least sum of costs at which
        each place is reached, and the arc that reaches it. The state of a byte-pair machine is its last
        symbol; a prefix has one encoding, so no two states of a place are both reached.
        """
        size = np.diff(ends, prepend=0)
        stop = np.repeat(ends, size)
        offset = np.arange(len(chars)) - np.repeat(ends - size, size)
        start, n, symbol = self.compose(chars, stop)
        end, far = start + n - 1, offset[start]
        longest = int(size.max(initial=0))
        order = np.argsort(far.astype(np.uint16) if longest < 1 << 16 else far, kind="stable")
        least, by = np.full(len(chars), np.inf), np.full(len(chars), -1)
        cuts = np.searchsorted(far[order], np.arange(longest + 1))
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            arc = order[x:y]
            cost = self.cost[symbol[arc]]
            if k:
                before = start[arc] - 1
                live = np.isfinite(least[before])
                if self.kind == BPE:
                    live = np.flatnonzero(live)
                    live = live[self.follows(symbol[by[before[live]]], symbol[arc[live]])]
                arc, cost = arc[live], cost[live] + least[before[live]]
            better = cost < least[end[arc]]
            arc = arc[better]
            least[end[arc]], by[end[arc]] = cost[better], arc
        path, at = np.full(len(chars), -1), ends[size > 0] - 1
        while len(at):
            arc = by[at]
            if (arc < 0).any():
                raise ValueError("a part has no path")
            path[start[arc]] = symbol[arc]
            at = (start[arc] - 1)[far[arc] > 0]
        used = np.flatnonzero(path >= 0)
        return used, path[used]

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of words, one after the other, and where those of each word end. Words are cut where two characters are inside no piece."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = self.code[text].astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.ones(len(chars), bool)
        cut[:-1] = self.inside.find(chars[:-1] * self.width + chars[1:]) < 0
        cut[ends - 1] = True
        start, symbol = self.shortest(chars, np.flatnonzero(cut) + 1)
        if self.fresh:
            keys, answers = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            if len(self.answer) < MOST_KEPT * 10:
                keys, answers = np.concatenate([self.known.key[self.known.key >= 0], keys]), np.concatenate([self.answer[self.known.row[self.known.key >= 0]], answers])
            keys, at = np.unique(keys, return_index=True)
            self.known, self.answer, self.fresh = tx.Table(keys), answers[at], []
        size = np.ones(len(symbol), np.int64)
        bare = np.flatnonzero(symbol >= len(self.names))
        other = {c: self.fallback(chr(c)) for c in np.unique(text[start[bare]]).tolist()}
        if other:
            size[bare] = [len(other[c]) for c in text[start[bare]].tolist()]
        to = np.cumsum(size)
        ids = np.repeat(symbol, size).astype(np.int32)
        for c, own in other.items():
            at = bare[text[start[bare]] == c]
            for k, i in enumerate(own):
                ids[to[at] - size[at] + k] = i
        return ids, np.concatenate([[0], to])[np.searchsorted(start, ends)]

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def _learn(self, words: list[str]) -> None:
        """Solve words and keep their paths; beyond MOST_KEPT words, those that were met once only are forgotten."""
        if len(self.rows) > MOST_KEPT:
            stay = np.flatnonzero(self.uses > 1)
            names = list(self.rows)
            size = np.diff(self.ends)
            self.pool = self.pool[np.repeat(self.uses > 1, size)]
            self.ends = np.concatenate([[0], np.cumsum(size[stay])])
            self.rows, self.uses = {names[i]: k for k, i in enumerate(stay.tolist())}, self.uses[stay] // 2
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            ids, ends = self.solve(some)
            self.rows.update(zip(some, range(len(self.rows), len(self.rows) + len(some)), strict=True))
            self.ends = np.concatenate([self.ends, ends + self.ends[-1]])
            self.pool = np.concatenate([self.pool, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(some), np.int32)])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and where those of each text end."""
        split = [self.cut.findall(self.normalise(t)) for t in texts]
        met = set().union(*split)
        if not self.rows.keys() >= met:
            if len(self.rows) > MOST_KEPT:
                self._learn([])
            self._learn(list(met - self.rows.keys()))
        word = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int64)
        self.uses[np.unique(word)] += 1
        size = (self.ends[1:] - self.ends[:-1])[word]
        to = np.cumsum(size)
        ids = self.pool[np.repeat(self.ends[word] - to + size, size) + np.arange(to[-1] if len(to) else 0)]
        return ids, np.concatenate([[0], to])[np.cumsum([len(x) for x in split])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    @cached_property
    def written(self) -> list[str]:
        """What ids are decoded to; bytes from 128 up as lone surrogates."""
        say = {NORMAL: lambda p: p.replace(MARK, " "), USER: lambda p: p.replace(MARK, " "), UNKNOWN: lambda _: " ⁇ ", BYTE: lambda p: bytes([int(p[3:5], 16)]).decode("ascii", "surrogateescape")}
        return [say.get(k, lambda _: "")(p) for p, k in zip(self.names, self.kinds, strict=True)]

    def decode(self, ids) -> str:
        text = "".join(map(self.written.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _merges(symbols: list[int], pairs: dict, rank: dict) -> tuple[list[tuple[int, int, int]], list[int]]:
    """((first symbol, last symbol, rank of the next merge) of each step, what is left) of merging the best pair, leftmost first."""
    steps = []
    while True:
        best = min(((rank[i], k, i) for k in range(len(symbols) - 1) if (i := pairs.get((symbols[k], symbols[k + 1]))) is not None), default=None)
        steps.append((symbols[0], symbols[-1], best[0] if best else NEVER))
        if best is None:
            return steps, symbols
        symbols[best[1] : best[1] + 2] = [best[2]]


@lru_cache(maxsize=2)
def _compiled(data: bytes) -> Transducer:
    return Transducer.read(data)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = part.column(1).to_pylist()
                ids, ends = t.encode_all([text or "" for text in texts])
                cuts = [0, *ends.tolist()]
                whole = [t.decode(ids[a:b].tolist()) == (text or "").replace(MARK, " ") for text, a, b in zip(texts, cuts, cuts[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([text is None for text in texts]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts), pa.int64()), lists, pa.array(whole)], ["doc_id", "n_pieces", "ids", "lossless"])

    return run


def encode_pieces(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, lossless of every row of docs(doc_id, text).

    lossless: decoding gives back the text, but for the blank mark, which decodes to a blank. A null text has
    null ids, an empty one none. Repeated rows give a row each; other columns are ignored. The model file is
    read by the driver and shipped.
    """
    model = docs.sparkSession.sparkContext.broadcast(_compiled(_read(model_path)))  # a few megabytes, as large as the model
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tx.tidy(_encode(model)), "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of rows of encoded(doc_id, ids)."""
    model = encoded.sparkSession.sparkContext.broadcast(_compiled(_read(model_path)))
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tx.tidy(_decode(model)), "doc_id long, text string")
