import numpy as np
import pytest

from kbspark.operators import keyword
from kbspark.operators.keyword import B, K1, Postings


def counted(n, vocabulary, seed):
    """Chunks with tokens of very different frequency, as rows of their counts."""
    r = np.random.default_rng(seed)
    rows = [np.unique((vocabulary * r.random(r.integers(5, 60)) ** 3).astype(int), return_counts=True) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    size = np.array([c.sum() for _, c in rows])
    token, tf = (np.concatenate(x).astype(np.int32) for x in zip(*rows, strict=True))
    df = np.bincount(token, minlength=vocabulary)
    return r.permutation(n).astype(np.int64), size, ends, token, tf, np.log(1 + (n - df + 0.5) / (df + 0.5)), size.mean()


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_against_all_scores(block):
    data = counted(3000, 400, 1)
    ids, size, ends, token, tf, idf, mean = data
    own = Postings(*data, block)
    r = np.random.default_rng(2)
    row = np.repeat(np.arange(len(ids)), np.diff(ends))
    weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
    for _ in range(60):
        tokens = np.unique((400 * r.random(r.integers(1, 12)) ** 2).astype(int))
        hit = np.isin(token, tokens)
        score = np.round(np.bincount(row[hit], weight[hit], len(ids)), 6)
        found = np.bincount(row[hit], minlength=len(ids))
        for wanted in (None, len(tokens)):
            fits = np.flatnonzero(found == wanted) if wanted else np.flatnonzero(found)
            order = fits[np.lexsort((ids[fits], -score[fits]))][:10]
            floors = [0.0] + ([score[order[-1]]] if len(order) == 10 else [])
            for floor in floors:
                s, i = own.search(tokens, 10, floor, wanted)
                best = np.lexsort((i, -s))[:10]
                assert i[best].tolist() == ids[order].tolist() and (s[best] == score[order]).all()


def test_less_than_half_of_the_postings_are_read():
    own = Postings(*counted(16_000, 3000, 3))
    r = np.random.default_rng(5)
    for _ in range(40):
        own.search(np.unique((3000 * r.random(20) ** 2).astype(int)), 10, 0.0)
    assert 0 < own.read < own.there / 2


def test_shards_and_matches(spark, monkeypatch):
    r = np.random.default_rng(7)
    texts = [" ".join(f"t{int(60 * x**2)}" for x in r.random(r.integers(1, 30))) for _ in range(800)] + ["", None, "t1 t1 t1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(f"t{int(60 * x**2)}" for x in r.random(4))) for k in range(25)] + [(99, None), (98, "nowhere t1")], "query_id long, text string")
    for match in ("any", "all"):
        got = {}
        for most in (500_000, 1):  # by shards, by a join of postings
            monkeypatch.setattr(keyword, "MOST_ASKED", most)
            got[most] = sorted(tuple(x) for x in keyword.keyword_topk(asked, docs, 7, match).select("query_id", "rank", "id", "score").collect())
        assert got[1] == got[500_000] and got[1]
