import numpy as np
import pytest

from kbspark.operators import inverted, vectors

SCHEMA = "id long, embedding array<float>"


def clustered(n, dim, centers, seed=0, spread=0.15):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centers, dim))
    x = c[r.integers(0, centers, n)] + spread * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], SCHEMA)


def brute(q, x, k, digits=6):
    s = np.round(q.astype(np.float64) @ x.astype(np.float64).T, digits)
    return {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]}


@pytest.fixture(scope="module")
def file(spark):
    x = clustered(6000, 16, 40)
    x[:900] = x[0]  # a vector of many rows: its list is cut
    return x, inverted.build(table(spark, x), part_rows=200)


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 7])  # shipped queries; queries that meet lists by a shuffle
def test_exact(spark, file, block):
    x, f = file
    q = np.concatenate([x[::150], clustered(20, 16, 40, 3)])
    asked = table(spark, q).withColumnRenamed("id", "query_id")
    tally = {}
    out = inverted.search(f, asked, 10, tally=tally, block=block)
    assert pairs(out) == brute(q, x, 10)
    exact = vectors.topk(asked, table(spark, x), 10)
    assert sorted(out.select("query_id", "id", "score", "rank").collect()) == sorted(exact.select("query_id", "id", "score", "rank").collect())
    # rows compared whole: k, those that a code cannot tell from them, and the 900 equal ones for queries near them
    assert tally["whole"] < 0.1 * len(q) * len(x)
    if block == 4096:
        assert tally["codes"] < 0.75 * len(q) * len(x)


def test_lists_are_cut_and_grow(spark, file):
    x, f = file
    assert f.parts.max() > 3 and f.size.sum() == len(x)
    assert f.rows.groupBy("list", "part").count().agg({"count": "max"}).first()[0] < 900
    assert 30 < len(f.centers) <= 2 * np.sqrt(len(x))
    assert len(inverted.build(table(spark, x[1000:1400])).centers) < 30


@pytest.mark.parametrize("block", [4096, 7])
def test_approximate_recall(spark, file, block):
    x, f = file
    q = clustered(60, 16, 40, 8)
    tally = {}
    near = pairs(inverted.search(f, table(spark, q).withColumnRenamed("id", "query_id"), 10, slack=0.4, tally=tally, block=block))
    want = brute(q, x, 10)
    assert len(near & want) >= 0.9 * len(want)
    assert block != 4096 or tally["codes"] < 0.35 * len(q) * len(x)


def test_odd_rows_and_reopened(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (1, [0.5, 0.5]), (9, [1.0, 0.0])]
    inverted.build(spark.createDataFrame(rows, SCHEMA), path=str(tmp_path / "file"))
    f = inverted.open_file(spark, str(tmp_path / "file"))
    asked = spark.createDataFrame([(1, [1.0, 0.2]), (1, [1.0, 0.2]), (2, None), (3, [1.0])], "query_id long, embedding array<float>")
    out = inverted.search(f, asked, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in out] == [(1, 1, 1.0), (1, 9, 1.0), (1, 1, 0.6)]
    assert [r["id"] for r in inverted.search(f, asked, 99).orderBy("rank").collect()] == [1, 9, 1, 2, 8]
    empty = inverted.build(spark.createDataFrame([], SCHEMA))
    assert inverted.search(empty, asked, 3).count() == 0 and inverted.search(f, asked.limit(0), 3).count() == 0


def test_tiles_of_the_exact_search_are_bounded(monkeypatch):
    monkeypatch.setattr(vectors, "SCORES", 64)
    r = np.random.default_rng(1)
    q, x = r.normal(size=(8, 4)), r.normal(size=(500, 4))
    found = vectors._joined(vectors._best_of(np.arange(8), q, None, np.arange(500), x, None, 5, None, 6, False), 5)[0]
    assert set(zip(found[0].tolist(), found[2].tolist(), strict=True)) == brute(q, x, 5)
