"""Embedding near-dedup: a forest of random-projection trees with spill, compared leaf by leaf.

Equal vectors of a label become one class first. The forest is fitted on a bounded sample: every node
splits at the sample's median along a random direction, and what lies near the cut goes both ways. All
classes are sent down all trees. A leaf is compared in blocks of at most BLOCK classes, one task group
per pair of blocks, so a leaf of any size is split; a tile returns link counts and tree edges of its
components, one row a class, never its pairs. A pair that meets in several leaves is counted in the
first leaf that both share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.stages import components, partitions, settle, spread_join

SAMPLE = 50_000  # vectors that the forest is fitted on, at most
LEAF = 160  # classes of one label that a leaf should have
BLOCK = 512
SPILL = 0.3  # half width of the zone that goes both ways, in deviations of the projected difference of a pair at the threshold


class Tree:
    """Nodes in arrays: direction, cut, and the two children (0: a leaf)."""

    def __init__(self, sample: np.ndarray, depth: int, margin: float, seed: int):
        rng = np.random.default_rng(seed)
        self.margin, d = margin, sample.shape[1]
        self.direction, self.cut, self.child = [], [], []
        todo = [(np.arange(len(sample)), 0, -1, 0)]
        for rows, level, parent, side in todo:
            me = len(self.cut)
            if parent >= 0:
                self.child[parent][side] = me
            v = rng.standard_normal(d)
            v /= np.linalg.norm(v)
            x = sample[rows] @ v
            cut = float(np.median(x)) if len(rows) else 0.0
            self.direction.append(v)
            self.cut.append(cut)
            self.child.append([0, 0])
            # a node that spill would mostly copy to both sides stays a leaf
            if level < depth and len(rows) >= 16 and (np.abs(x - cut) <= margin).mean() < 0.5:
                todo += [(rows[x <= cut + margin], level + 1, me, 0), (rows[x >= cut - margin], level + 1, me, 1)]
        self.direction, self.cut, self.child = np.array(self.direction, np.float32), np.array(self.cut, np.float32), np.array(self.child, np.int32)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of all rows."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        done = []
        while len(row):
            end = self.child[node, 0] == 0
            done.append((row[end], node[end]))
            row, node = row[~end], node[~end]
            p = np.einsum("ij,ij->i", x[row], self.direction[node]) - self.cut[node]
            left, right = p <= self.margin, p >= -self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.child[node[left], 0], self.child[node[right], 1]])
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(sample: np.ndarray, total: int, trees: int, threshold: float) -> list[Tree]:
    depth = max(0, int(np.ceil(np.log2(max(total, 1) / LEAF))))
    margin = SPILL * float(np.sqrt(max(0.0, 2 - 2 * threshold) / max(1, sample.shape[1])))
    return [Tree(sample, depth, margin, 1000 + t) for t in range(trees)]


def _routed(forest, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = part.column(3)
                size = np.diff(np.asarray(vectors.offsets))
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                x = np.zeros((part.num_rows, dim), np.float64)
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                for k in range(dim):  # vectors of another length are cut or filled up to find their leaves
                    ok = size > k
                    x[ok, k] = flat[first[ok] + k]
                empty = ~x.any(1)
                x[empty] = 1
                x = _unit(x).astype(np.float32)
                rows, codes = [], []
                base = 0
                for t in trees:
                    r, n = t.leaves(x)
                    rows.append(r)
                    codes.append(n + base)
                    base += len(t.cut)
                rows, codes = np.concatenate(rows), np.concatenate(codes).astype(np.int32)
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(4)), pa.array(codes), lists.take(take)], ["label", "rep", "copies", "v", "code", "codes"])

    return run


def _first_shared(codes: pa.ListArray, a: np.ndarray, b: np.ndarray, code: int) -> np.ndarray:
    """Whether ``code`` is the smallest that the lists of each pair (a, b) of rows share."""
    rows, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends, flat = np.asarray(codes.offsets), np.asarray(codes.values)
    names: dict[bytes, int] = {}
    lists: list[np.ndarray] = []
    kind = np.empty(len(rows), np.int64)
    for i, r in enumerate(rows):
        own = flat[ends[r] : ends[r + 1]]
        kind[i] = names.setdefault(own.tobytes(), len(names))
        if kind[i] == len(lists):
            lists.append(own)
    kind = kind[back]
    pair, back = np.unique(kind[: len(a)] * len(names) + kind[len(a) :], return_inverse=True)
    ok = np.array([np.intersect1d(lists[p // len(names)], lists[p % len(names)], assume_unique=True)[0] == code for p in pair], bool)
    return ok[back]


def _tiles(threshold: float):
    def compare(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group).combine_chunks()
        rep, copies, side = (t[c].to_numpy() for c in ("rep", "copies", "side"))
        code = int(t["code"][0].as_py())
        vectors, codes = (pa.concat_arrays(t[c].chunks) for c in ("v", "codes"))
        x = _unit(vectors.flatten().to_numpy().reshape(len(rep), -1))  # a leaf has vectors of one length
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        near = x[left] @ x[right].T >= threshold
        if side[0] == 0:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        ok = _first_shared(codes, i, j, code) if len(i) else np.zeros(0, bool)
        n = np.bincount(i[ok], copies[j[ok]], len(rep))
        if side[0] != 0:  # of two blocks, each pair was seen from the left only
            n += np.bincount(j[ok], copies[i[ok]], len(rep))
        root = np.arange(len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        root = rank.copy()
        while True:  # smallest rank among linked ones, until nothing changes
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            new = np.minimum(new, new[order][new])
            if (new == root).all():
                break
            root = new
        to = rep[order][root]
        keep = (n > 0) | (to != rep)
        return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(n[keep].astype(np.int64)), pa.array(to[keep])], ["rep", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for s, e in zip([0, *cut], [*cut, len(ids)], strict=True):
                if s == e:
                    continue
                if group and tuple(ids[s]) != last:
                    yield compare(group)
                    group = []
                group.append(batch.slice(s, e - s))
                last = tuple(ids[s])
        if group:
            yield compare(group)

    return run


def _fine() -> Column:
    """Whether a row of (label, v) can link at all."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, trees: int = 6) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors have one length and the cosine, in
    double precision, reaches ``threshold``. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing. Rows that repeat a vec_id are vectors of their own and count
    as links of one another. Other columns are ignored. Recall is that of the forest; no false links.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"  # cosines are of doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("string").alias("label"))
    valid = rows.where(F.col("vec_id").isNotNull() & _fine())
    classes = settle(valid.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("label", "rep", "copies", "v"), "vector-classes")
    total = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # leaves are split by label
    first = classes.select("v", F.xxhash64("rep").alias("o")).orderBy("o").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()  # at most SAMPLE rows
    first = first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first
    p = partitions(spark)
    if len(first):
        lengths = pc.list_value_length(first)
        dim = int(pc.mode(lengths)[0]["mode"].as_py())
        sample = first.filter(pc.equal(lengths, dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        forest = spark.sparkContext.broadcast(fit(_unit(sample), total, trees, threshold))
        routed = classes.mapInArrow(_routed(forest, dim), f"label string, rep long, copies long, v {kind}, code int, codes array<int>")
        routed = settle(routed.withColumn("leaf", F.xxhash64("label", F.size("v"), "code")).drop("label"), "vector-leaves")
        sizes = routed.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        spread = routed.join(sizes, "leaf").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        spread = spread.select(
            "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "rep", "copies", "v", "code", "codes"
        )
        found = spread.repartition(p, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(_tiles(threshold), "rep long, n long, root long")
        found = settle(found, "vector-links")
        linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
        roots = components(found.where("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("node", "rep")
        known = classes.select("rep", "copies").join(linked, "rep", "left").join(roots, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    else:
        known = spark.createDataFrame([], "rep long, n long, component long")
    twins = classes.where("copies > 1").select("label", "v", "rep")
    twin = spread_join(valid, twins, ["label", "v"], "vec_id").where("vec_id <> rep").groupBy("vec_id").agg(F.min("rep").alias("rep"))
    out = rows.select("vec_id", _fine().alias("ok"))
    out = out.join(twin, "vec_id", "left").withColumn("rep", F.when(F.col("ok"), F.coalesce("rep", "vec_id"))).join(known, "rep", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
