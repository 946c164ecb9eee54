"""V6: a persisted inverted file of vectors, searched exactly by bounds or approximately with less of them.

Rows lie in lists around centers, about as many lists as the square root of the rows, each list cut into parts so
that no task writes or reads a large one alone. A row is kept twice in one Parquet table: as a code of a byte a dimension
(what is left of it after its center, with the length of the code's own error) and whole; scans of codes do not read whole
vectors. The table is partitioned by folders of neighbouring lists, so a search reads the folders of its lists.

A search scores codes. Code and error give an inner product from below and above, center and radius one of a list
from above. The lists nearest to a query give a k-th best score to start from; lists that cannot reach it are not
read, rows that cannot reach it are dropped, and only what is left, a few rows more than k, is compared whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.jobs import MOST_BYTES, partitions, settle, shared_dir, sized

QUERY_BLOCK = 4096  # queries that are shipped at once; more meet the lists by a shuffle
PART_ROWS = 50_000  # of a list that a task takes at once
SAMPLE = 200_000  # rows that centers are fitted on, at most
ROUNDS = 8
SCORES = 1 << 20  # of a matrix at once: 8 MB
FOUND = 1 << 18  # candidates that come before those of too low scores are dropped
EPS = 1e-6  # scores are rounded to six digits


@dataclass
class InvertedFile:
    rows: DataFrame  # folder, list, part, id, code, scale, err, dist, embedding
    centers: np.ndarray
    size: np.ndarray  # rows of each list
    radius: np.ndarray  # largest distance of a row to its center
    folder: np.ndarray  # first and last folder of each list
    parts: np.ndarray


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    step = max(1, SCORES // len(centers))
    for s in range(0, len(x), step):
        out[s : s + step] = np.argmax(x[s : s + step] @ centers.T - (centers**2).sum(1) / 2, 1)
    return out


def means(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most n centers of rows by Lloyd's rounds, from evenly spaced rows on; centers without rows go."""
    centers = np.unique(x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = nearest(x, centers)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = total[count > 0] / count[count > 0, None]
    return centers


def usable(corpus: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """Rows with a vector of the dimension, by default the most frequent one, without null and infinite components."""
    whole = corpus.where("embedding is not null")
    if dim is None:
        dim = whole.select(F.size("embedding").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
        dim = dim[0]["d"] if dim else 0
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return whole.where((F.size("embedding") == dim) & ~bad), dim


def fit_centers(rows: DataFrame, n: int, lists: int, dim: int) -> np.ndarray:
    """Centers of about so many lists: branches of a small sample on the driver, lists within branches by tasks."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    few = lambda most: rows.where(bucket < int((1 << 40) * min(1.0, most / max(n, 1)))).select("embedding")
    branches = max(1, round(lists**0.5))
    t = few(20_000).toArrow()  # about 20,000 rows
    x = np.concatenate([matrix(c, len(c)) for c in t["embedding"].chunks if len(c)] or [np.zeros((0, dim))])
    if not len(x):
        return np.zeros((1, dim))
    first = means(x, branches)
    if lists <= 64:
        return means(x, lists)
    shipped = rows.sparkSession.sparkContext.broadcast(first)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(matrix(b.column(0), b.num_rows), shipped.value) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), b.column(0)], ["branch", "embedding"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        c = means(matrix(pa.concat_arrays(t["embedding"].chunks), t.num_rows), -(-lists // len(shipped.value)))
        return pa.table([pa.array(list(c), pa.list_(pa.float64()))], ["center"])

    kind = dict(rows.dtypes)["embedding"]
    found = few(min(SAMPLE, 64 * lists)).mapInArrow(branch, f"branch long, embedding {kind}").groupBy("branch").applyInArrow(fit, "center array<double>")
    return np.array([r["center"] for r in found.orderBy("center").collect()], np.float64)


def _encoder(shipped, slots: np.ndarray, parts: np.ndarray, folders: int):
    """Rows with list, part, folder, code, scale, err, dist; slots: where the parts of each list begin, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shipped.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column(1), n)
            near = nearest(x, centers)
            rest = x - centers[near]
            scale = np.maximum(np.abs(rest).max(1), 1e-30) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            err = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1)) + 1e-12
            part = batch.column(2).to_numpy() % parts[near]
            at = (slots[near] + part) * folders // slots[-1]
            width = x.shape[1]
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(code.tobytes())])
            columns = [pa.array(at.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(part.astype(np.int32)), batch.column(0), codes, pa.array(scale), pa.array(err), pa.array(np.sqrt((rest**2).sum(1))), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["folder", "list", "part", "id", "code", "scale", "err", "dist", "embedding"])

    return run


def build(corpus: DataFrame, path: str | None = None, lists: int | None = None, part_rows: int = PART_ROWS) -> InvertedFile:
    """Index every usable row of corpus(id long, embedding); see ``usable``. Written to path, by default in the shared folder.

    Centers are fitted on a bounded sample; all rows are indexed. Lists of more than part_rows rows, by the sample, are cut.
    """
    spark = corpus.sparkSession
    rows, dim = usable(corpus.select("id", "embedding"))
    n = rows.count()
    lists = min(lists or max(1, int(np.ceil(n**0.5))), max(1, MOST_BYTES // (8 * max(dim, 1))))
    centers = fit_centers(rows, n, lists, dim)
    shipped = spark.sparkContext.broadcast(centers)
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << 40))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shipped.value), np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(nearest(matrix(b.column(0), b.num_rows), shipped.value), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["list", "n"])

    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows.where(bucket < int((1 << 40) * share)).select("embedding").mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()
    guess = np.zeros(len(centers))
    for r in sample:
        guess[r["list"]] = r["n"] / share
    parts = np.maximum(1, np.ceil(guess / part_rows)).astype(np.int64)
    slots = np.concatenate([[0], np.cumsum(parts)])
    folders = int(min(slots[-1], max(1, partitions(spark))))
    path = path or f"{shared_dir(spark)}/inverted-{uuid.uuid4().hex}"
    kind = dict(corpus.dtypes)["embedding"]
    coded = rows.select("id", "embedding", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)).cast("long").alias("h"))
    coded = coded.mapInArrow(_encoder(shipped, slots, parts, folders), f"folder int, list int, part int, id long, code binary, scale double, err double, dist double, embedding {kind}")
    coded.repartitionById(folders, "folder").sortWithinPartitions("list", "part", "id").write.partitionBy("folder").parquet(f"{path}/rows")
    table = spark.read.schema(coded.schema).parquet(f"{path}/rows")
    about = table.groupBy("list").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.min("folder").alias("first"), F.max("folder").alias("last")).collect()
    by = {r["list"]: r for r in about}
    of = [(int(c), [float(v) for v in centers[c]], by[c]["n"], by[c]["radius"], by[c]["first"], by[c]["last"], int(parts[c])) for c in range(len(centers)) if c in by]
    spark.createDataFrame(of, "list int, center array<double>, n long, radius double, first int, last int, parts long").coalesce(1).write.parquet(f"{path}/lists")
    return open_file(spark, path)


def open_file(spark: SparkSession, path: str) -> InvertedFile:
    """An inverted file that ``build`` wrote."""
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    n = max((r["list"] for r in lists), default=-1) + 1
    dim = len(lists[0]["center"]) if lists else 0
    out = InvertedFile(spark.read.parquet(f"{path}/rows") if lists else spark.createDataFrame([], "folder int, list int, part int, id long, code binary, scale double, err double, dist double, embedding array<float>"), np.zeros((n, dim)), np.zeros(n, np.int64), np.zeros(n), np.zeros((n, 2), np.int64), np.ones(n, np.int64))
    for r in lists:
        k = r["list"]
        out.centers[k], out.size[k], out.radius[k], out.folder[k], out.parts[k] = r["center"], r["n"], r["radius"], (r["first"], r["last"]), r["parts"]
    return out


def _kth(group: np.ndarray, low: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of each of n groups, the k-th largest value, or minus infinity."""
    order = np.lexsort((-low, group))
    g = group[order]
    start = np.searchsorted(g, np.arange(n))
    at = start + k - 1
    has = (at < len(g)) & (np.append(g, -1)[np.minimum(at, len(g))] == np.arange(n))
    out = np.full(n, -np.inf)
    out[has] = low[order[at[has]]]
    return out


class _Best:
    """Candidates of a task's queries; those that k others surely exceed are dropped."""

    def __init__(self, q: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.norm, self.floor, self.k = q, np.sqrt((q * q).sum(1)), floor.copy(), k
        self.found: list[tuple] = []
        self.held = 0

    def meet(self, which: np.ndarray, no: int, center: np.ndarray, ids: np.ndarray, code: np.ndarray, scale: np.ndarray, err: np.ndarray) -> None:
        """Rows of one list meet the queries that look there."""
        step = max(1, SCORES // max(1, len(which)))
        for s in range(0, len(ids), step):
            own = slice(s, s + step)
            q = self.q[which]
            mid = (q @ center)[:, None] + (q @ code[own].T.astype(np.float64)) * scale[own]
            slack = self.norm[which][:, None] * err[own] + 1e-12
            i, j = np.nonzero(mid + slack >= self.floor[which][:, None] - EPS)
            self.found.append((which[i], np.full(len(i), no, np.int32), ids[own][j], (mid - slack)[i, j], (mid + slack)[i, j]))
            self.held += len(i)
            if self.held > FOUND:
                self.settle()

    def settle(self) -> tuple:
        if not self.found:
            return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        g, no, ids, low, high = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.floor = np.maximum(self.floor, _kth(g, low, self.k, len(self.q)))
        keep = high >= self.floor[g] - EPS
        self.found = [(g[keep], no[keep], ids[keep], low[keep], high[keep])]
        self.held = 0  # counts what came since
        return self.found[0]


_FOUND = "query_id long, list int, id long, low double, high double"


def _candidates(names: np.ndarray, found: tuple) -> pa.RecordBatch:
    g, no, ids, low, high = found
    return pa.RecordBatch.from_arrays([pa.array(names[g], pa.int64()), pa.array(no), pa.array(ids, pa.int64()), pa.array(low), pa.array(high)], ["query_id", "list", "id", "low", "high"])


def _codes(batch, n: int) -> np.ndarray:
    data = b"".join(batch.column("code").to_pylist())
    return np.frombuffer(data, np.int8).reshape(n, -1)


def _scan(shipped, k: int):
    """Of a scan of codes, the candidates of the shipped queries, each in the lists where it looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, floor, centers, looks = shipped.value
        best = _Best(q, floor, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            no, code = batch.column("list").to_numpy(), _codes(batch, batch.num_rows)
            ids, scale, err = (batch.column(c).to_numpy() for c in ("id", "scale", "err"))
            cuts = np.flatnonzero(np.diff(no, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                which = looks(int(no[a]), q, best.floor)
                if len(which):
                    best.meet(which, int(no[a]), centers[no[a]], ids[a:b], code[a:b], scale[a:b], err[a:b])
        yield _candidates(names, best.settle())

    return run


@dataclass
class _Nearest:
    """Queries look in the lists with the nearest centers, as many as hold k rows twice."""

    at: dict[int, np.ndarray]

    def __call__(self, no: int, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return self.at.get(no, np.zeros(0, np.int64))


@dataclass
class _Reach:
    """Queries look in lists that may hold a row above their floor, but for those where they looked first."""

    centers: np.ndarray
    radius: np.ndarray
    slack: float
    first: dict[int, np.ndarray]

    def __call__(self, no: int, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        up = q @ self.centers[no] + self.slack * np.sqrt((q * q).sum(1)) * self.radius[no]
        which = np.flatnonzero(up >= floor - EPS)
        return np.setdiff1d(which, self.first[no], assume_unique=True) if no in self.first else which


def _of_lists(file: InvertedFile, lists: np.ndarray) -> DataFrame:
    """Codes of these lists: folders are pruned, then lists."""
    folders = sorted({int(f) for a, b in file.folder[lists] for f in range(a, b + 1)})
    return file.rows.where(F.col("folder").isin(folders) & F.col("list").isin([int(x) for x in lists])).select("list", "id", "code", "scale", "err")


def _looks(file: InvertedFile, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the lists with the nearest centers, as many as hold k rows twice."""
    order = np.argsort(-(q @ file.centers.T), 1, kind="stable")
    before = np.cumsum(file.size[order], 1) - file.size[order]
    i, j = np.nonzero((before < 2 * k) & (file.size[order] > 0))
    return i, order[i, j]


def _reach(file: InvertedFile, q: np.ndarray, floor: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the lists that may hold a row above the floor."""
    up = q @ file.centers.T + slack * np.sqrt((q * q).sum(1))[:, None] * file.radius[None]
    return np.nonzero((up >= floor[:, None] - EPS) & (file.size > 0))


def _in_steps(file: InvertedFile, n: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, len(file.centers)))
    return (slice(s, s + step) for s in range(0, n, step))


def _shipped_search(file: InvertedFile, asked: pa.Table, k: int, slack: float, tally: dict) -> DataFrame:
    spark = file.rows.sparkSession
    names = asked["query_id"].to_numpy()
    q = matrix(pa.concat_arrays(asked["embedding"].chunks), len(names))

    def job(looks: _Nearest | _Reach, lists: np.ndarray, floor: np.ndarray) -> DataFrame:
        shipped = spark.sparkContext.broadcast((names, q, floor, file.centers, looks))
        return _of_lists(file, lists).mapInArrow(_scan(shipped, k), _FOUND)

    found = [(i + s.start, c) for s in _in_steps(file, len(q)) for i, c in [_looks(file, q[s], k)]]
    i, c = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(c, kind="stable")
    lists, start = np.unique(c[order], return_index=True)
    near = _Nearest({int(x): y for x, y in zip(lists, np.split(i[order], start[1:]), strict=True)})
    first = settle(job(near, lists, np.full(len(q), -np.inf)), "inverted-first")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))
    reached = {r["query_id"]: r["low"] for r in first.withColumn("r", rank).where(F.col("r") == k).select("query_id", "low").collect()}
    floor = np.array([reached.get(int(x), -np.inf) for x in names])
    times = np.zeros(len(file.centers), np.int64)
    for s in _in_steps(file, len(q)):
        times += np.bincount(_reach(file, q[s], floor[s], slack)[1], minlength=len(times))
    tally["codes"] = int((times * file.size).sum())
    lists = np.flatnonzero(times)
    return first.unionByName(job(_Reach(file.centers, file.radius, slack, near.at), lists, floor)) if len(lists) else first


def _joined_search(file: InvertedFile, asked: DataFrame, k: int, slack: float) -> DataFrame:
    """As _shipped_search for any number of queries: they are dealt to the parts of their lists, a task a list, part and block."""
    spark = asked.sparkSession
    shipped = spark.sparkContext.broadcast(file.centers)
    light = InvertedFile(None, file.centers, file.size, file.radius, file.folder, file.parts)  # type: ignore[arg-type]

    def looks(nearest_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q, floor = matrix(b.column(1), b.num_rows), b.column(2).to_numpy(zero_copy_only=False)
                    for step in _in_steps(light, len(q)):
                        i, c = _looks(light, q[step], k) if nearest_only else _reach(light, q[step], floor[step], slack)
                        for s in range(0, len(i), 4096):
                            take = pa.array(i[s : s + 4096] + step.start)
                            yield pa.RecordBatch.from_arrays([*(x.take(take) for x in b.columns), pa.array(c[s : s + 4096].astype(np.int32))], ["query_id", "embedding", "floor", "list"])

        return run

    kind = dict(asked.dtypes)["embedding"]

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_candidates(np.zeros(0, np.int64), _Best(np.zeros((0, 1)), np.zeros(0), k).settle())])
        best = _Best(matrix(pa.concat_arrays(left["embedding"].chunks), left.num_rows), left["floor"].to_numpy(), k)
        no = int(key[0].as_py())
        best.meet(np.arange(left.num_rows), no, shipped.value[no], right["id"].to_numpy(), _codes(right, right.num_rows), right["scale"].to_numpy(), right["err"].to_numpy())
        return pa.Table.from_batches([_candidates(left["query_id"].to_numpy(), best.settle())])

    parts = spark.createDataFrame([(c, int(p)) for c, p in enumerate(file.parts)], "list int, parts int")

    def job(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs, "inverted-looks")
        blocks = pairs.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")).join(F.broadcast(parts), "list")  # a row a list
        left = pairs.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = file.rows.select("list", "part", "id", "code", "scale", "err").join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = left.select("list", "part", "block", "query_id", "embedding", "floor").groupBy("list", "part", "block")
        return left.cogroup(right.select("list", "part", "block", "id", "code", "scale", "err").groupBy("list", "part", "block")).applyInArrow(meet, _FOUND)

    plain = asked.select("query_id", "embedding", F.lit(float("-inf")).alias("floor"))
    schema = f"query_id long, embedding {kind}, floor double, list int"
    first_looks = settle(plain.mapInArrow(looks(True), schema), "inverted-nearest")
    first = settle(job(first_looks), "inverted-first")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))
    reached = first.withColumn("r", rank).where(F.col("r") == k).select("query_id", "low")
    more = plain.drop("floor").join(reached, "query_id", "left").select("query_id", "embedding", F.coalesce("low", F.lit(float("-inf"))).alias("floor"))
    rest = more.mapInArrow(looks(False), schema).join(first_looks.select("query_id", "list"), ["query_id", "list"], "left_anti").select("query_id", "embedding", "floor", "list")
    return first.unionByName(job(rest))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def search(file: InvertedFile, queries: DataFrame, k: int, slack: float = 1.0, digits: int = 6, tally: dict | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank of the k best rows by inner product for each of queries(query_id long, embedding); ties by id.

    With slack 1 the result is that of an exact search. With less, the radius of a list counts only in this part, so
    fewer lists are read; rows of those that are not read may be missing. Queries without a usable vector of the
    file's dimension have no rows; repeated query ids are one query. tally gets "codes" (scored, where queries are
    shipped) and "whole": the rows that were compared whole.
    """
    dim = file.centers.shape[1]
    asked = usable(queries.select("query_id", "embedding").dropDuplicates(["query_id"]), dim)[0]
    asked = settle(asked, "inverted-queries")
    tally = {} if tally is None else tally
    tally.update(codes=0, whole=0)
    n = asked.limit(block + 1).count()
    if not n or not len(file.centers):
        return asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    found = _shipped_search(file, asked.toArrow().sort_by("query_id"), k, slack, tally) if n <= block else _joined_search(file, asked, k, slack)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))
    found = settle(found, "inverted-found")
    least = found.withColumn("r", rank).where(F.col("r") == k).select("query_id", F.col("low").alias("least"))
    left = found.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least") - EPS)).select("query_id", "list", "id").distinct()
    left = settle(left, "inverted-whole")
    tally["whole"] = left.count()
    lists = np.array([r["list"] for r in left.select("list").distinct().collect()], np.int64)
    folders = sorted({int(f) for a, b in file.folder[lists] for f in range(a, b + 1)})
    whole = file.rows.where(F.col("folder").isin(folders)).select("list", "id", F.col("embedding").alias("own"))
    scored = whole.join(sized(left), ["list", "id"]).join(sized(asked), "query_id").select("query_id", "id", F.round(dot(F.col("embedding"), F.col("own")), digits).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)
