import numpy as np
import pytest

from kbspark.operators.linkage import average_labels, clusters_average


def brute(ids, blocks, x, cut):
    """Merges the nearest pair of all again and again."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for b in set(blocks):
        own = [k for k in range(len(ids)) if blocks[k] == b]
        d = np.sqrt(np.maximum(2 - 2 * x[own] @ x[own].T, 0))
        np.fill_diagonal(d, np.inf)
        n, members = np.ones(len(own)), {k: [ids[own[k]]] for k in range(len(own))}
        while len(members) > 1:
            i, j = sorted(divmod(int(np.argmin(d)), len(own)))
            if d[i, j] > cut:
                break
            d[i] = d[:, i] = (d[i] * n[i] + d[j] * n[j]) / (n[i] + n[j])
            d[i, i] = np.inf
            d[j] = d[:, j] = np.inf
            n[i] += n[j]
            members[i] += members.pop(j)
        out |= {m: min(c) for c in members.values() for m in c}
    return out


def vectors_of(n, seed, dim=6):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(1, dim)) + 0.35 * r.normal(size=(n // 2, dim)), r.normal(size=(n - n // 2, dim)) + 1])
    x[10:40] = x[10]  # copies
    return x.astype(np.float32)


@pytest.mark.parametrize("local, tile", [(2000, 4096), (60, 30)])  # a task a group; rounds, with clusters of several tiles
def test_brute(spark, local, tile):
    x = vectors_of(400, 3)
    ids, blocks = [7 * k for k in range(400)], [k % 2 for k in range(400)]
    df = spark.createDataFrame([(i, b, [float(v) for v in row]) for i, b, row in zip(ids, blocks, x, strict=True)], "id long, block int, embedding array<float>")
    found = {r["id"]: r["cluster"] for r in clusters_average(df, 0.4, local, tile).collect()}
    want = brute(ids, blocks, x.astype(np.float64), 0.6)
    assert found == want and 10 < len(set(want.values())) < 300
    assert max(list(want.values()).count(c) for c in set(want.values())) > 40  # larger than a tile of 30


def test_more_rows_than_a_task_takes(spark):
    x = vectors_of(3000, 4, 4)
    df = spark.createDataFrame([(k, "b", [float(v) for v in row]) for k, row in enumerate(x)], "id long, block string, embedding array<float>")
    found = clusters_average(df, 0.5, local=500, tile=700).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    first = np.unique(x, axis=0, return_index=True, return_counts=True)
    keep = np.sort(first[1])
    weight = dict(zip(first[1], first[2], strict=True))
    label = keep[average_labels(unit[keep].astype(np.float64), np.array([weight[k] for k in keep]), 0.5)]
    of = dict(zip(keep.tolist(), label.tolist(), strict=True))
    assert all(r["cluster"] == of[r["id"]] for r in found if r["id"] in of) and len(found) == 3000


def test_odd_rows(spark):
    rows = [(1, "b", [1.0, 0.0]), (2, "b", [1.0, 0.01]), (3, None, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "b", None), (6, "c", [0.0, 0.0]), (7, "c", [0.0, 0.0]), (2, "b", [1.0, 0.01])]
    df = spark.createDataFrame(rows, "id long, block string, embedding array<double>")
    found = clusters_average(df, 0.85).collect()
    assert {(r["id"], r["cluster"]) for r in found} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6)}
    assert clusters_average(df.limit(0), 0.85).count() == 0
