import numpy as np
import pytest

from kbspark.llm import embedding_dedup
from kbspark.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n int, rep long, code int, root long"


def vectors(seed=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((400, 32))
    out = [*base]
    for i in range(60):
        out += [base[i] + 0.2 * r.standard_normal(32) for _ in range(i % 6)]
    out += [base[0]] * 30  # copies
    center = r.standard_normal(32)
    out += [center + 0.15 * r.standard_normal(32) for _ in range(150)]  # a dense group
    return np.array(out, np.float32)


@pytest.mark.parametrize("block", [512, 16])
def test_recall_and_precision(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    x = vectors()
    labels = [i % 2 if i >= 400 else 0 for i in range(len(x))]
    odd = [(None, 0), ([0.0] * 32, 0), ([float("nan")] * 32, 0), ([1.0, None], 0), ([], 0), ([1.0] * 32, None), ([1.0, 2.0], 0), ([2.0, 4.0], 0)]
    rows = [(i, [float(v) for v in row], labels[i], 1, 2, 3, 4) for i, row in enumerate(x)] + [(10_000 + i, v, l, 1, 2, 3, 4) for i, (v, l) in enumerate(odd)]
    found = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93).collect()}
    assert len(found) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(near, False)
    want = near.sum(1)
    got = np.array([found[i]["n_links"] for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    root = list(range(len(x)))
    while True:  # the smallest id among linked ones, until nothing changes
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    for i in range(len(x)):  # components lie within those of all links
        c = found[i]["component_id"]
        assert found[i]["kept"] == (c == i) and c <= i and root[c] == root[i]
    more = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93, trees=24).collect()}
    assert [more[i]["n_links"] for i in range(len(x))] == want.tolist()  # where all links are found, they are the same
    assert [more[i]["component_id"] for i in range(len(x))] == root
    assert [found[10_000 + i]["n_links"] for i in range(8)] == [0] * 6 + [1, 1]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_at_the_threshold_are_found():
    """Recall of the forest for pairs just above the threshold, at the depth of a hundred thousand vectors of a label."""
    r = np.random.default_rng(1)
    x = r.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:3000]
    noise = r.standard_normal(q.shape)
    noise -= (noise * q).sum(1, keepdims=True) * q
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.931 * q + np.sqrt(1 - 0.931**2) * noise
    met = np.zeros(len(q), bool)
    for tree in embedding_dedup.fit(x, 100_000, 6, 0.93):
        own = set(zip(*(a.tolist() for a in tree.leaves(q.astype(np.float32))), strict=True))
        for row, leaf in zip(*(a.tolist() for a in tree.leaves(y.astype(np.float32))), strict=True):
            met[row] |= (row, leaf) in own
    assert met.mean() >= 0.97


def test_types_and_ids(spark):
    """Vectors of doubles, ids that are int, null and repeated."""
    rows = [(1, [1.0, 0.5], "a"), (1, [1.0, 0.5], "a"), (None, [1.0, 0.5], "a"), (2, [1.0, 0.51], "a"), (3, [-1.0, 0.5], "a"), (4, [1.0, 0.5], None)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in found) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
