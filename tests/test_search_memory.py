import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from kbspark.operators import inverted, vectors


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, out


def test_products_of_many_near_ties(monkeypatch):
    """All of a million products may be among the best, so all are taken in double precision."""
    q, x = np.ones((1024, 64)), np.ones((1024, 64))
    most, (r, ids, s) = peak(lambda: vectors._above(q, np.arange(1024), x, 10, None, 6, np.full(1024, -np.inf)))
    assert (ids.reshape(1024, 10) == np.arange(10)).all() and (r.reshape(1024, 10) == np.arange(1024)[:, None]).all() and (s == 64).all()
    assert most < 200, most


def test_hits_of_scopes_are_put_together_by_their_number():
    r = np.random.default_rng(3)
    q, x, scope = r.normal(size=(2000, 8)), r.normal(size=(6000, 8)).astype(np.float32), np.arange(6000) % 10
    shipped = SimpleNamespace(value=(np.arange(2000), q, None))
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + 400)), pa.array(list(x[s : s + 400])), pa.array(scope[s : s + 400])], ["id", "embedding", "scope"])
    batches = [batch(s) for s in range(0, 6000, 400)]
    most, out = peak(lambda: list(vectors._block_topk(shipped, 10, False, None, 6, False)(iter(batches))))
    found = {(a, b, c): d for b_ in out for a, b, c, d in zip(*(b_.column(i).to_pylist() for i in range(4)), strict=True)}
    exact = np.round(np.einsum("ij,kj->ik", q, x.astype(float)), 6)
    for i in (0, 7, 1999):
        for c in (0, 9):
            own = np.flatnonzero(scope == c)
            best = own[np.lexsort((own, -exact[i, own]))[:10]]
            assert all(abs(found[i, c, int(j)] - exact[i, j]) < 2e-6 for j in best)
    assert len(found) == 2000 * 10 * 10
    assert most < 200, most


def test_candidates_of_a_list(monkeypatch):
    r = np.random.default_rng(4)
    best = inverted._Best(r.normal(size=(4096, 16)), np.full(4096, -np.inf), 10)
    code = r.integers(-127, 128, size=(4096, 16)).astype(np.int8)
    most, _ = peak(lambda: best.meet(np.arange(4096), 0, np.zeros(16), np.arange(4096), code, np.full(4096, 0.01), np.full(4096, 1e-6)))
    g, _, ids, low, _ = best.settle()
    assert np.bincount(g, minlength=4096).min() >= 10
    assert most < 200, most


def test_vectors_are_not_sent_to_every_block(spark, monkeypatch):
    """With many blocks of queries each row of the corpus is shuffled once, and the hits are those of one block."""
    from pyspark.sql import functions as F

    def moved():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        none = spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    r = np.random.default_rng(6)
    t = spark.createDataFrame([(i, i % 3, [float(v) for v in r.integers(0, 4, 6)]) for i in range(2000)], "id long, g int, embedding array<float>")
    q = t.select(F.col("id").alias("query_id"), "g", "embedding")
    for more in ({}, {"scope": "g"}, {"per": "g"}, {"floor": 0.9}):
        find = lambda: sorted(tuple(x) for x in vectors.topk(q, t, 5, cosine=True, **more).collect())  # noqa: E731, B023
        want = find()
        with monkeypatch.context() as m:
            m.setattr(vectors, "QUERY_BLOCK", 64)
            m.setattr(vectors, "SLICE", 200)
            before = moved()
            assert find() == want and len(want) > 5000
            assert moved() - before < 2000 * (4 + (15 if "per" in more else 5)) + 500
