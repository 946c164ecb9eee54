"""Average linkage of any number of rows, by rounds of reciprocal nearest neighbours.

Average linkage is reducible: clusters that merge do not come nearer to a third than the nearer of the two was. So all
pairs that are each other's nearest can merge at once, with the result of merging the nearest pair of all again and
again; a cluster whose nearest is beyond the cut is final; and a nearest neighbour stays one until it merges. A round
looks for the nearest of the clusters that are new or lost theirs, in tasks of a pair of tiles, which return a row a
cluster and sums of pairs only for clusters that lie in several tiles. Equal vectors are one row with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.jobs import release, settle, sized
from kbspark.operators.vectors import SCORES, clusters_linked

LOCAL = 2000  # linked rows or clusters that one task merges; more go through rounds
TILE = 4096  # rows of a tile
DIGITS = 9  # of distances that are compared


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def merged(total: np.ndarray, size: np.ndarray, cut: float) -> np.ndarray:
    """Of clusters in order of their ids, with sums of the distances of their pairs, the first one of each one's last cluster."""
    label = np.arange(len(size))
    names = label.copy()
    while len(names) > 1:
        mean = np.round(total / size[:, None] / size[None], DIGITS)
        np.fill_diagonal(mean, np.inf)
        near = np.argmin(mean, 1)
        dist = mean[np.arange(len(names)), near]
        pair = np.flatnonzero((near[near] == np.arange(len(names))) & (np.arange(len(names)) < near) & (dist <= cut))
        if not len(pair):
            break
        into = np.arange(len(names))
        into[near[pair]] = pair
        keep = np.flatnonzero(into == np.arange(len(names)))
        code = np.searchsorted(keep, into)
        label = names[into][np.searchsorted(names, label)]
        total = np.stack([np.bincount(code, row, len(keep)) for row in total.T])
        total = np.stack([np.bincount(code, row, len(keep)) for row in total.T])
        size, names = np.bincount(code, size, len(keep)), names[keep]
    return label


def average_labels(x: np.ndarray, weight: np.ndarray, cut: float) -> np.ndarray:
    """Of unit vectors in order of their ids, the first row of each one's cluster; all distances at once."""
    return merged(_distances(x, x) * weight[:, None] * weight[None], weight.astype(np.float64), cut)


def _local(cut: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id").combine_chunks()
        ids = t["id"].to_numpy()
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        return pa.table([t["id"], pa.array(ids[average_labels(_unit(x), t["weight"].to_numpy(), cut)])], ["id", "cluster"])

    return run


def _side(t: pa.Table) -> tuple:
    """Clusters, first and last row of each, unit vectors, weights, weight of each cluster, whether it lies in this tile alone."""
    t = t.combine_chunks().sort_by([("cluster", "ascending"), ("id", "ascending")]).combine_chunks()
    c = t["cluster"].to_numpy()
    x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)
    begin = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
    w = t["weight"].to_numpy().astype(np.float64)
    return c[begin], begin, np.append(begin[1:], len(c)), _unit(x), w, np.add.reduceat(w, begin), t["whole"].to_numpy(zero_copy_only=False)[begin]


def _totals(left: tuple, right: tuple) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, sums of distances with all right clusters) of slices of the left clusters."""
    (lc, lb, le, lx, lw, _, _), (rc, rb, _, rx, rw, _, _) = left, right
    step, k = max(1, SCORES // len(rx)), 0
    while k < len(lc):
        to = max(k + 1, int(np.searchsorted(le, lb[k] + step, "right")))  # whole clusters of a slice, or a larger one alone
        total = np.zeros((to - k, len(rc)))
        for s in range(lb[k], le[to - 1], step):
            e = min(s + step, le[to - 1])
            d = np.add.reduceat(_distances(lx[s:e], rx) * rw[None] * lw[s:e, None], rb, axis=1)
            np.add.at(total, np.searchsorted(lb, np.arange(s, e), "right") - 1 - k, d)
        yield k, to, total
        k = to


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Nearest right cluster of each left one where both lie in these tiles, and sums of the other pairs."""
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
    if left.num_rows and right.num_rows:
        a, b = _side(left), _side(right)
        (lc, *_, ln, lwhole), (rc, *_, rn, rwhole) = a, b
        for k, to, total in _totals(a, b):
            same = lc[k:to, None] == rc[None]
            split = ~lwhole[k:to, None] | ~rwhole[None]
            mean = np.round(total / ln[k:to, None] / rn[None], DIGITS)
            mean[same | split] = np.inf
            near = np.argmin(mean, 1)
            has = np.flatnonzero(mean[np.arange(to - k), near] < np.inf)
            out.append((lc[k + has], rc[near[has]], mean[has, near[has]], np.ones(len(has), bool)))
            i, j = np.nonzero(split & ~same)
            out.append((lc[k + i], rc[j], total[i, j], np.zeros(len(i), bool)))
    c, other, value, done = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table([pa.array(c), pa.array(other), pa.array(value), pa.array(done)], ["cluster", "other", "value", "done"])


def _blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of the distances of all pairs of clusters in these tiles, as blocks of a matrix."""
    out = []
    if left.num_rows and right.num_rows:
        group, a, b = left["group"][0].as_py(), _side(left), _side(right)
        out = [(group, a[0][k:to].tolist(), b[0].tolist(), total.tobytes()) for k, to, total in _totals(a, b)]
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["group", "rows", "columns", "total"])


def _finish(cut: float):
    """cluster, into of a group whose clusters are few, from its blocks of sums and its sizes."""

    def run(blocks: pa.Table, sizes: pa.Table) -> pa.Table:
        sizes = sizes.combine_chunks().sort_by("cluster")
        names = sizes["cluster"].to_numpy()
        total = np.zeros((len(names), len(names)))
        for b in blocks.to_batches():
            for rows, columns, sums in zip(b.column("rows"), b.column("columns"), b.column("total"), strict=True):
                i, j = (np.searchsorted(names, x.values.to_numpy()) for x in (rows, columns))
                total[np.ix_(i, j)] += np.frombuffer(sums.as_py()).reshape(len(i), len(j))
        return pa.table([pa.array(names), pa.array(names[merged(total, sizes["n"].to_numpy().astype(np.float64), cut)])], ["cluster", "into"])

    return run


def _paired(members: DataFrame, sizes: DataFrame, stale: DataFrame | None, tile: int, f, schema: str) -> DataFrame:
    """f over pairs of tiles of a group: clusters of stale(cluster), or all, with all clusters; settled.

    Clusters of fewer rows than a tile lie in one tile with others, larger ones in tiles of their own.
    """
    small = sizes.where(F.col("rows") < tile).groupBy("group").agg(F.ceil(2 * F.sum("rows") / tile).cast("long").alias("parts"))
    where = sizes.join(small, "group", "left").select("cluster", (F.col("rows") < tile).alias("whole"), "parts", F.ceil(2 * F.col("rows") / tile).cast("long").alias("own"))
    at = F.when(F.col("whole"), F.pmod(F.xxhash64("cluster"), "parts")).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("id"), "own")))
    columns = ["group", "cluster", "id", "weight", "embedding", "whole"]
    placed = members.join(where, "cluster").select(*columns, at.alias("tile"))
    placed = settle(placed.join(stale.withColumn("stale", F.lit(True)), "cluster", "left") if stale is not None else placed.withColumn("stale", F.lit(True)), "linkage-placed")
    tiles = lambda df: df.groupBy("group").agg(F.collect_set("tile").alias("tiles"))  # noqa: E731  a long a tile
    left = placed.where("stale").join(tiles(placed), "group").select(F.col("tile").alias("i"), F.explode("tiles").alias("j"), *columns)
    right = placed.join(tiles(placed.where("stale")), "group").select(F.explode("tiles").alias("i"), F.col("tile").alias("j"), *[F.col(c).alias(c) for c in columns])
    out = settle(left.groupBy("group", "i", "j").cogroup(right.groupBy("group", "i", "j")).applyInArrow(f, schema), "linkage-met")
    release(placed)
    return out


def _nearest(members: DataFrame, sizes: DataFrame, stale: DataFrame | None, tile: int) -> DataFrame:
    """cluster, near, dist of the clusters of stale(cluster), among all clusters of their group of members."""
    met = _paired(members, sizes, stale, tile, _meet, "cluster long, other long, value double, done boolean")
    size = sizes.select("cluster", "n")
    parts = met.where("not done").groupBy("cluster", "other").agg(F.sum("value").alias("total"))
    parts = parts.join(size, "cluster").join(size.select(F.col("cluster").alias("other"), F.col("n").alias("m")), "other")
    every = met.where("done").select("cluster", "value", "other").unionByName(parts.select("cluster", F.round(F.col("total") / F.col("n") / F.col("m"), DIGITS).alias("value"), "other"))
    return every.groupBy("cluster").agg(F.min(F.struct("value", "other")).alias("m")).select("cluster", F.col("m.other").alias("near"), F.col("m.value").alias("dist"))


def _rounds(rows: DataFrame, cut: float, local: int, tile: int) -> DataFrame:
    """id, cluster of rows(group, id, weight, embedding) by rounds, until groups have few clusters left."""
    members = settle(rows.select("group", F.col("id").alias("cluster"), "id", "weight", "embedding"), "linkage")
    known, done = None, []
    while True:
        sizes = settle(members.groupBy("group", "cluster").agg(F.count("*").alias("rows"), F.sum("weight").alias("n")), "linkage-sizes")
        few = settle(sizes.groupBy("group").agg(F.count("*").alias("c")).withColumn("few", F.col("c") <= local).select("group", "few"), "linkage-few")
        if not few.where("few").isEmpty():
            ending, their = (df.join(few.where("few"), "group", "left_semi") for df in (members, sizes))
            blocks = _paired(ending, their, None, tile, _blocks, "group long, rows array<long>, columns array<long>, total binary")
            into = blocks.groupBy("group").cogroup(their.groupBy("group")).applyInArrow(_finish(cut), "cluster long, into long")
            done.append(settle(ending.join(into, "cluster").select("id", F.col("into").alias("cluster")), "linkage-done"))
            members, sizes = (df.join(few.where("few"), "group", "left_anti") for df in (members, sizes))
            if members.isEmpty():
                return reduce(DataFrame.unionByName, done)
        stale = None if known is None else sizes.select("cluster").join(known.select("cluster"), "cluster", "left_anti")
        near = _nearest(members, sizes, stale, tile)
        near = settle(near if known is None else near.unionByName(known.join(sizes.select("cluster"), "cluster", "left_semi")), "linkage-near").where(F.col("dist") <= cut)  # others are final: nothing comes nearer
        active = near.select("cluster")
        other = near.select(F.col("cluster").alias("near"), F.col("near").alias("back"))
        pairs = settle(near.join(other, "near").where("back = cluster and cluster < near").select("cluster", "near"), "linkage-pairs")
        if pairs.isEmpty():  # none is left, or distances that are equal but for rounding made a ring
            least = near.join(active.withColumnRenamed("cluster", "near"), "near", "left_semi").select(F.least("cluster", "near").alias("cluster"), F.greatest("cluster", "near").alias("near"), "dist")
            pairs = settle(least.orderBy("dist", "cluster", "near").limit(1).select("cluster", "near"), "linkage-pairs")
            if pairs.isEmpty():
                return reduce(DataFrame.unionByName, [*done, members.select("id", "cluster")])
        done.append(settle(members.join(active, "cluster", "left_anti").select("id", "cluster"), "linkage-done"))
        moved = members.join(active, "cluster", "left_semi").join(pairs.select(F.col("near").alias("cluster"), F.col("cluster").alias("into")), "cluster", "left")
        members = settle(moved.select("group", F.coalesce("into", "cluster").alias("cluster"), "id", "weight", "embedding"), "linkage")
        gone = pairs.select("cluster").union(pairs.select("near"))
        known = near.join(gone, "cluster", "left_anti").join(gone.select(F.col("cluster").alias("near")), "near", "left_anti").select("cluster", "near", "dist")


def clusters_average(corpus: DataFrame, similarity: float, local: int = LOCAL, tile: int = TILE) -> DataFrame:
    """Id, cluster by average linkage of unit vectors, cut at Euclidean distance 1 - similarity, within blocks of
    rows(id, block, embedding); cluster is the smallest id.

    Clusters merge only where two of their rows lie within the distance, so each lies inside one of
    clusters_linked. Linked groups of at most ``local`` different vectors are clustered by a task each, larger ones by
    rounds over tiles until so many clusters are left, whose sums of distances one task takes; the result is the same. Of equal distances (to nine digits) the smaller ids merge first. A row
    without vector stands alone; a null block is a block.
    """
    rows = corpus.where("embedding is not null").select("id", F.to_json(F.struct("block")).alias("block"), "embedding")
    same = settle(rows.groupBy("block", "embedding").agg(F.min("id").alias("first"), F.count("*").alias("weight")), "equal-vectors")
    linked = clusters_linked(same.select(F.col("first").alias("id"), "block", "embedding"), similarity)
    one = settle(same.withColumnRenamed("first", "id").join(linked.withColumnRenamed("cluster", "group"), "id").select("group", "id", "weight", "embedding"), "linked")
    sizes = settle(one.groupBy("group").agg(F.count("*").alias("n")), "linked-sizes")
    few = one.join(sizes.where(f"n > 1 and n <= {local}"), "group").select("group", "id", "weight", "embedding")
    found = few.groupBy("group").applyInArrow(_local(1 - similarity), "id long, cluster long")
    many = sizes.where(f"n > {local}")
    if not many.isEmpty():
        found = found.unionByName(_rounds(one.join(sized(many), "group"), 1 - similarity, local, tile))
    label = one.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
    copies = sized(same.where("weight > 1").select("block", "embedding", "first"))
    back = rows.join(copies, ["block", "embedding"], "left").select(F.col("id").alias("row"), F.coalesce("first", "id").alias("id")).join(label, "id")
    return corpus.select("id").join(back.select(F.col("row").alias("id"), "cluster").distinct(), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
