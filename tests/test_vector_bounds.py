import numpy as np
import pytest

from kbspark.operators import vectors


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e3, 1e30])
@pytest.mark.parametrize("floor", [None, 0.3])
def test_few_products_are_taken_in_double_precision(monkeypatch, scale, floor):
    """The k best of each query against all products; scores that are near the last one and equal ones included."""
    r = np.random.default_rng(3)
    x = r.integers(0, 3, (9_000, 32)) * scale
    x[5_000:5_050] = x[7]
    q, ids, k = x[:300], r.permutation(9_000), 6
    rounded, whole = [0], np.round
    monkeypatch.setattr(vectors, "SCORES", 1 << 19)
    monkeypatch.setattr(vectors.np, "round", lambda a, *more: rounded.__setitem__(0, rounded[0] + np.size(a)) or whole(a, *more))
    found = []
    for at in (0, 4_000):
        found += vectors._best_of(np.arange(300), q, None, ids[at : at + 4_000 + at], x[at : at + 4_000 + at], None, k, floor, 6, False)
    i, _, got, score = vectors._joined(found, k)[0]
    if scale < 1e3 and scale > 1e-12:
        assert rounded[0] < 300 * 9_000 // 10
    monkeypatch.undo()
    s = np.round(q @ x.T, 6)
    s[q @ x.T <= (floor if floor is not None else -np.inf)] = -np.inf
    for n in range(0, 300, 10):
        best = sorted(((-a, b) for a, b in zip(s[n], ids, strict=True) if a > -np.inf))[:k]
        mine = sorted((-a, b) for a, b in zip(score[i == n], got[i == n], strict=True))
        assert len(mine) == len(best)
        np.testing.assert_allclose([a for a, _ in mine], [a for a, _ in best], rtol=1e-12)
        if scale <= 1:
            assert [b for _, b in mine] == [b for _, b in best]


def test_rows_that_are_no_numbers_hide_no_others():
    x = np.eye(4)
    x[1] = np.nan
    r, _, ids, s = vectors._joined(vectors._best_of(np.arange(1), np.ones((1, 4)), None, np.arange(4), x, None, 2, None, 6, False), 2)[0]
    assert sorted(ids.tolist()) == [0, 2] and s.tolist() == [1, 1] and r.tolist() == [0, 0]


def test_candidates_of_a_group_rank_as_candidates_of_each_query_do(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(i, i % 4 if i % 9 else None, None if i % 7 == 0 or i % 4 == 1 and i > 10 else r.random(5).tolist()) for i in range(120)]
    t = spark.createDataFrame(rows, "id long, g int, embedding array<float>")
    queries = t.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("g").alias("group"), "embedding")
    members = t.select(F.col("g").alias("group"), (F.col("id") % 3).alias("owner"), F.col("id").alias("chunk_id"))
    chunks = t.select(F.col("id").alias("chunk_id"), "embedding")
    want = vectors.rerank_candidates(queries.join(members, "group"), queries, chunks, 5)
    found = vectors.rerank_members(members, queries, chunks, 5)
    key = lambda df: sorted((x["query_id"], x["rank"], x["chunk_id"], x["score"]) for x in df.collect())
    assert len(key(want)) > 100 and key(found) == key(want)
