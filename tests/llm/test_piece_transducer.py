import itertools
import os
import random

import numpy as np
import pytest
from common import AWKWARD, frame, prose, rows

from kbspark.llm.piece_transducer import BPE, BYTE, MARK, MODEL, NORMAL, UNIGRAM, UNKNOWN, Transducer, decode_pieces, encode_pieces


def texts():
    r = random.Random(11)
    bits = ["the", "ing", " ", "  ", "    ", "\n", "\t", "é", "ß", "\U0001f600", "漢字", "...", "(", "Hello", "WORLD", "123", "==", "x" * 9, "\x01", "'s", "tion", "–", "a", "b", "c"]
    some = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(1500)]
    return [*(t or "" for t in AWKWARD), *some, prose(1, 200), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 70 + "x"]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_same_as_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        t = Transducer.read(f.read())
    import pyarrow.parquet as pq

    real = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    for x in texts() + real:
        assert t.encode(x) == sp.encode(x), x
        assert t.decode(t.encode(x)) == x.replace(MARK, " ")
    found = rows(encode_pieces(frame(spark, AWKWARD)))
    for i, x in enumerate(AWKWARD):
        assert found[i]["ids"] == (None if x is None else sp.encode(x)) and found[i]["lossless"]
    back = rows(decode_pieces(encode_pieces(frame(spark, AWKWARD))))
    assert [back[i]["text"] for i in range(len(AWKWARD))] == AWKWARD
    assert encode_pieces(frame(spark, [])).count() == 0
    twice = frame(spark, AWKWARD).selectExpr("if(doc_id < 4, null, cast(doc_id as int)) doc_id", "text")
    assert sorted(len(r["ids"] or []) for r in encode_pieces(twice.union(twice)).collect()) == sorted(2 * [len(sp.encode(x or "")) for x in AWKWARD])
    long = "x" * 30_000 + " the quick brown fox" * 50_000
    assert t.encode(long) == sp.encode(long)


def test_unigram_shortest_path():
    r = random.Random(2)
    names = {"".join(r.choice("ab" + MARK) for _ in range(r.randrange(1, 4))) for _ in range(14)} | {"a", MARK}
    pieces = [("<unk>", 0.0, UNKNOWN), *((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)), *((p, -r.random() * 9, NORMAL) for p in sorted(names))]
    t = Transducer(pieces, UNIGRAM, prefix=True, fold=False)
    cost = {p: -s for p, s, k in pieces if k == NORMAL}

    def brute(x):
        if not x:
            return 0.0
        return min((cost.get(x[:k], -t.low if k == 1 else float("inf")) + brute(x[k:])) for k in range(1, min(3, len(x)) + 1))

    for x in map("".join, itertools.product("ab ", repeat=6)):
        ids = t.encode(x)
        total, k = 0.0, 0
        while k < len(ids):
            if ids[k] < 257:
                total, k = total - t.low, k + 1
            else:
                total, k = total - t.score[ids[k]], k + 1
        assert total == pytest.approx(brute(t.normalise(x)))


def toy(r, alphabet="abc" + MARK):
    """A byte-pair model: merges in the order of their ranks, each of two symbols that exist by then."""
    symbols = list(alphabet[:3])
    names = list(symbols)
    for _ in range(r.randrange(4, 14)):
        new = r.choice(symbols) + r.choice([*symbols, MARK])
        if new not in names and MARK not in new[1:]:
            names.append(new)
            symbols.append(new)
    merges = [n for n in names if len(n) > 1]
    r.shuffle(names)
    return [("<unk>", 0.0, UNKNOWN), *((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)), *((n, -float(merges.index(n)) if n in merges else -100.0, NORMAL) for n in names)]


def merged(t, text):
    """Of all neighbours whose union is a piece always the best, leftmost first."""
    s = list(text)
    while True:
        best = min(((-t.score[t.id[s[k] + s[k + 1]]], k) for k in range(len(s) - 1) if s[k] + s[k + 1] in t.id), default=None)
        if best is None:
            return s
        s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]


def test_byte_pairs_by_brute_force():
    """The shortest path is the cheapest sequence of pieces among those whose neighbours may follow one another, and what merging gives."""
    for seed in range(40):
        r = random.Random(seed)
        t = Transducer(toy(r), BPE, prefix=False, fold=False)
        words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(60)]
        for x in words:
            best = None
            for cuts in itertools.product([0, 1], repeat=len(x) - 1):
                at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(x)]
                pieces = [x[a:b] for a, b in itertools.pairwise(at)]
                if all(len(p) == 1 or p in t.id for p in pieces) and all(merged(t, p) == [p] for p in pieces) and all(merged(t, p + q) == [p, q] for p, q in itertools.pairwise(pieces)):
                    cost = sum(-t.score[t.id[p]] if p in t.id else -t.low for p in pieces)
                    assert best is None
                    best = cost, pieces
            own = [i for p in merged(t, x) for i in ([t.id[p]] if p in t.id else [t.byte[b] for b in p.encode()])]
            assert best[1] == merged(t, x) and t.encode(x) == own
        chars = np.array([t.number.get(c, 0) for c in words[0]])
        start, symbol = t.shortest(chars, np.array([len(chars)]))
        assert start[0] == 0 and t.cost[symbol].sum() == pytest.approx(sum(-t.score[t.id[p]] if p in t.id else -t.low for p in merged(t, words[0])))
