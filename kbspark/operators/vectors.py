"""Vector operators (V2-V13). Corpora stay distributed; sets of queries go to them in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.jobs import components, release, settle, spread_join

QUERY_BLOCK = 4096  # queries that are shipped at once
SLICE = 50_000  # rows of a file of the corpus where there are more queries
SCORES = 1 << 20  # of a matrix at once: 8 MB
EXACT = 1 << 14  # pairs whose products are taken in double precision at once
HELD = 1 << 20  # hits that a task keeps; more are handed on before their scope is through
MERGED = 1 << 17  # hits beyond twice the last ones that are put together at once
TILE = 512  # rows of a block that are compared with as many at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid_vectors(df: DataFrame, column: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """V9: (rows with a vector of the dimension, one row with the number of others)."""
    ok = F.coalesce(F.size(column) == dim, F.lit(False))
    return df.where(ok), df.agg(F.count_if(~ok).alias("dropped"))


def topk_one(corpus: DataFrame, vector: list[float], k: int, threshold: float | None = None, digits: int | None = None) -> DataFrame:
    """V2: id, score of the k rows of corpus(id, embedding) with the largest inner product; ties by id."""
    score = dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
    out = corpus.select("id", (F.round(score, digits) if digits is not None else score).alias("score"))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), "id").limit(k)


def kept(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k of their group with the largest scores; ties by id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.concatenate([first, [len(g)]])))
    return order[place < k]


def _matrix(column: pa.Array, n: int, cosine: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    if cosine:
        x /= np.maximum(_lengths(x), 1e-300)[:, None]
    return x


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.concatenate([(x[s : s + 4096] ** 2).sum(1) for s in range(0, len(x), 4096)] or [np.zeros(0)]))


def _above(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: float | None, digits: int, bound: np.ndarray):
    """(row, id, score) of the k best rows of x for each of q that may be among the k best of all, given that k scores
    of at least ``bound`` are known to be met; bound is raised.

    All products are taken in single precision, and only those that reach the bound, by more than single precision and
    rounding could be wrong, in double precision.
    """
    width = 10.0**-digits
    error = (q.shape[1] + 8) * 2.0**-23 * _lengths(q) * _lengths(x).max() + 1e-30
    plain = ~(error < 1e12)  # beyond single precision, or not finite: all are taken in double precision
    error[plain] = 0
    if floor is not None:
        bound[:] = np.maximum(bound, floor - width)
    with np.errstate(over="ignore", invalid="ignore"):
        q32, x32 = q.astype(np.float32), x.astype(np.float32)
    best, more, step, at = _NONE, [], max(1, SCORES // len(q)), 0
    while at < len(ids):
        to = min(len(ids), at + (min(step, 1024) if at == 0 else step))
        with np.errstate(over="ignore", invalid="ignore"):
            s = q32 @ x32[at:to].T
        if at == 0 and to > k:
            v = np.partition(np.where(np.isnan(s), -np.inf, s), to - k, 1)[:, to - k]
            bound[:] = np.where(plain, bound, np.maximum(bound, v - error))
        hit = s >= (bound - error - width).astype(np.float32)[:, None] - np.float32(1e-30)
        hit[plain] = True
        i, j = np.divmod(np.flatnonzero(hit), to - at)
        for n in range(0, len(i), EXACT):
            r, c = i[n : n + EXACT], j[n : n + EXACT] + at
            exact = np.einsum("ij,ij->i", q[r], x[c])
            ok = exact > (floor if floor is not None else -np.inf)
            more.append((r[ok], ids[c[ok]], np.round(exact[ok], digits)))
        if sum(len(m[0]) for m in more) > len(best[0]) or to == len(ids):
            best, more = tuple(np.concatenate(z) for z in zip(best, *more, strict=True)), []
            keep = kept(best[0], best[2], best[1], k)
            best = tuple(z[keep] for z in best)
            full = np.bincount(best[0], minlength=len(q)) >= k
            least = np.full(len(q), np.inf)
            np.minimum.at(least, best[0], best[2])
            bound[full] = np.maximum(bound[full], least[full] - width)
        at = to
    return best


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best_of(names, q, q_scope, ids, x, scope, k: int, floor: float | None, digits: int, scoped: bool, bound: np.ndarray | None = None):
    """(query, scope, id, score) of the best rows for each query: within each scope where there are any, only the query's own if
    scoped. Without scopes ``bound`` says what the rows before have reached."""
    out = []
    for c in np.unique(scope) if scope is not None else [None]:
        cols = np.arange(len(ids)) if c is None else np.flatnonzero(scope == c)
        rows = np.flatnonzero(q_scope == c) if scoped else np.arange(len(names))
        if not len(cols) or not len(rows):
            continue
        r, i, s = _above(q[rows], ids[cols], x[cols], k, floor, digits, bound if c is None and bound is not None else np.full(len(rows), -np.inf))
        out.append((rows[r], np.full(len(r), 0 if c is None else c), i, s))
    return out


def _joined(found: list, k: int):
    q, c, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
    low = c.min() if len(c) else 0
    if len(c) and c.max() != low:  # number the scopes
        _, code = np.unique(c, return_inverse=True)
        keep = kept(q.astype(np.int64) * (int(code.max()) + 1) + code, s, ids, k)
    else:
        keep = kept(q, s, ids, k)
    return [(q[keep], c[keep], ids[keep], s[keep])]


def _block_topk(shipped, k: int, cosine: bool, floor: float | None, digits: int, scoped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, q_scope = shipped.value
        best: list = []
        whole = 0  # hits when they were last put together
        bound = np.full(len(names), -np.inf)

        def out() -> pa.RecordBatch:
            i, c, ids, s = _joined(best, k)[0]
            return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(c.astype(np.int64)), pa.array(ids), pa.array(s)], ["query_id", "scope", "id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                scope = part.column(2).to_numpy(zero_copy_only=False) if part.num_columns > 2 else None
                best += _best_of(names, q, q_scope, part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), part.num_rows, cosine), scope, k, floor, digits, scoped, bound)
                if sum(len(b[0]) for b in best) > 2 * whole + MERGED:
                    best = _joined(best, k)
                    whole = len(best[0][0])
                    if whole > HELD:  # with many scopes; the last shuffle ranks them anyway
                        yield out()
                        best, whole = [], 0
        if best:
            yield out()

    return run


_HITS = "query_id long, scope long, id long, score double"


def _read(uri: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    store, path = pfs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(8192, columns=columns):
            yield batch.select(columns)


def _tiled(asked: DataFrame, rows: DataFrame, n: int, k: int, cosine: bool, floor: float | None, digits: int, scoped: bool) -> DataFrame:
    """Blocks of queries, a task each, read the corpus from files in the shared folder, so it is written once, not sent to every
    block. Where blocks are fewer than twice the cores, some tasks share a block's files."""
    kept = settle(rows.repartition(max(1, -(-rows.count() // SLICE)), "id"), "vectors")
    files, columns = sorted(kept.inputFiles()), kept.columns
    blocks = -(-n // QUERY_BLOCK)
    shares = max(1, min(len(files), -(-2 * asked.sparkSession.sparkContext.defaultParallelism // blocks)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * shares
    dealt = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("task", (block + F.col("share")).cast("int"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(got).combine_chunks()
            q = _matrix(pa.concat_arrays(t["embedding"].chunks), t.num_rows, cosine)
            shipped = SimpleNamespace(value=(t["query_id"].to_numpy(), q, t["scope"].to_numpy() if scoped else None))
            own = files[t["share"][0].as_py() :: shares]
            yield from _block_topk(shipped, k, cosine, floor, digits, scoped)(b for f in own for b in _read(f, columns))

        got, held = [], 0
        for batch in batches:
            if batch.num_rows:
                got.append(batch)
                held += batch.num_rows
                if held >= 2 * QUERY_BLOCK:  # a task has one block, of about so many queries
                    yield from found(got)
                    got, held = [], 0
        if got:
            yield from found(got)

    hits = settle(dealt.repartitionById(blocks * shares, "task").drop("task").mapInArrow(meet, _HITS), "hits")
    release(kept)
    return hits


def topk(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool = False, floor: float | None = None, digits: int = 6, per: str | None = None, scope: str | None = None) -> DataFrame:
    """V5, V3: query_id, id, score, rank of the k best rows of corpus(id long, embedding) for each of queries(query_id long, embedding).

    Up to QUERY_BLOCK queries are shipped and met by every corpus partition; more of them are cut into blocks whose
    tasks read the corpus from the shared folder. A task returns its k best a query, so the last shuffle
    has k rows a query and task. cosine normalises; floor keeps scores above it. Scores are rounded, ties go to
    the smaller id. ``per``: the k best of each value of a corpus column, ranked within it; ``scope``: only rows
    whose value of a column is the query's.
    """
    code = [F.xxhash64(per or scope).alias("scope")] if per or scope else []
    asked = queries.where("embedding is not null").select("query_id", "embedding", *([F.xxhash64(scope).alias("scope")] if scope else []))
    rows = corpus.where("embedding is not null").select("id", "embedding", *code)
    n = asked.limit(QUERY_BLOCK + 1).count()
    if n <= QUERY_BLOCK:
        t = asked.toArrow().sort_by("query_id").combine_chunks()  # at most QUERY_BLOCK rows
        q = _matrix(pa.concat_arrays(t["embedding"].chunks), n, cosine) if n else np.zeros((0, 0))
        shipped = corpus.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), q, t["scope"].to_numpy() if scope else None))
        found = rows.mapInArrow(_block_topk(shipped, k, cosine, floor, digits, bool(scope)), _HITS)
    else:
        found = _tiled(asked, rows, asked.count(), k, cosine, floor, digits, bool(scope))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", *(["scope"] if per else [])).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def topk_scoped(queries: DataFrame, corpus: DataFrame, allowed: DataFrame, k: int, **more) -> DataFrame:
    """V4: topk over owners any of whose chunk_ids is allowed(chunk_id); the filter comes before the ranking."""
    owners = corpus.select("id", F.explode("chunk_ids").alias("chunk_id")).join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi").select("id").distinct()
    return topk(queries, corpus.join(owners, "id", "left_semi"), k, **more)


def topk_federated(queries: DataFrame, corpus: DataFrame, k: int, per: int = 10, **more) -> DataFrame:
    """V7: of corpus(id, embedding, dataset, name), ``per`` rows a dataset, the best one of a name, then k a query."""
    found = topk(queries, corpus, per, per="dataset", **more).join(corpus.select("id", "name"), "id")
    one = found.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "name").orderBy(F.desc("score"), "id"))).where("_n = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).drop("_n")


def nearest(new: DataFrame, old: DataFrame, **more) -> DataFrame:
    """V8: query_id, id, score of the nearest old row of each new one, by cosine."""
    return topk(new, old, 1, cosine=True, **more).select("query_id", "id", "score")


def resolve(new: DataFrame, old: DataFrame, least: float = 0.9, scope: str | None = None, floor: float | None = 0.7) -> DataFrame:
    """query_id, match_id, node_id: the nearest old node of at least ``least`` (4 digits), else a node of its own id.
    scope: only nodes whose value of a column is the same; floor: similarity that the search asks for."""
    found = nearest(new, old, digits=4, scope=scope, floor=min(floor, least) if floor is not None else None).where(F.col("score") >= least).select("query_id", F.col("id").alias("match_id"))
    return new.select("query_id").join(found, "query_id", "left").select("query_id", "match_id", F.coalesce("match_id", "query_id").alias("node_id"))


def _tile_links(limit: float):
    """Of a tile's rows (a pair of sub-blocks of a block), links that span what lies within ``limit``: at most one a row."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        x = _matrix(pa.concat_arrays(t["embedding"].chunks), len(ids), True)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        i, j = np.nonzero(np.sqrt(np.maximum(2 - 2 * x[left] @ x[right].T, 0)) <= limit)
        i, j = left[i], right[j]
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        root = rank.copy()
        while True:  # the smallest rank among linked rows, until nothing changes
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        keep = root != rank
        return pa.table([pa.array(np.sort(ids)[root[keep]]), pa.array(ids[keep])], ["a", "b"])

    return run


def clusters_linked(corpus: DataFrame, similarity: float) -> DataFrame:
    """V10 at scale: id, cluster by single linkage of rows(id, block, embedding) of a block whose unit vectors lie within
    1 - similarity of each other. A block is compared in tiles of at most 2 TILE rows, whose tasks return spanning
    links, never pairs; a row without vector stands alone."""
    rows = corpus.where("embedding is not null").select("id", "block", "embedding")
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    own = spread_join(rows, sizes, ["block"], "id").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    tiles = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tiles = tiles.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "id", "embedding")
    links = tiles.groupBy("block", "i", "j").applyInArrow(_tile_links(1 - similarity), "a long, b long")
    found = components(settle(links, "cluster-links"))
    return corpus.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def rerank_candidates(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Of candidates(query_id, owner, chunk_id), distinct chunks by cosine with the query; int(most * owners / 2) a query."""
    limits = candidates.groupBy("query_id").agg(F.floor(F.lit(most) * F.countDistinct("owner") / 2).alias("n"))
    each = candidates.select("query_id", "chunk_id").distinct().join(chunks, "chunk_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = each.select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("embedding")) / (norm(F.col("q")) * norm(F.col("embedding"))), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.join(limits, "query_id").where("rank <= n").drop("n")


def rerank_members(members: DataFrame, queries: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """V11 where the candidates of a query are members(group, owner, chunk_id) of its group: rows of ``rerank_candidates``
    for queries(query_id, group, embedding), without a row a candidate. Candidates without a score come last, by id."""
    members, queries = members.where("group is not null"), queries.where("group is not null")
    limits = members.groupBy("group").agg(F.floor(F.lit(most) * F.countDistinct("owner") / 2).alias("n"))
    k = limits.agg(F.max("n")).first()[0] or 0
    each = members.select("group", F.col("chunk_id").alias("id")).distinct().join(chunks.withColumnRenamed("chunk_id", "id"), "id")
    scored = topk(queries, each, k, cosine=True, scope="group").select("query_id", F.col("id").alias("chunk_id"), "score")
    first = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy("group").orderBy("id"))).where(F.col("_n") <= k).select("group", "id")
    blank = queries.where("embedding is not null").join(first(each.where("embedding is null")), "group").unionByName(queries.where("embedding is null").join(first(each), "group"))
    rows = scored.unionByName(blank.select("query_id", F.col("id").alias("chunk_id"), F.lit(None).cast("double").alias("score")))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.join(queries.select("query_id", "group").join(limits, "group").select("query_id", "n"), "query_id").where("rank <= n").drop("n")


def boost_tables(hits: DataFrame, tables: DataFrame, factor: float = 1.5) -> DataFrame:
    """hits(query_id, id, kind, score) and, for queries without a hit of kind table, those of tables(query_id, id,
    kind, score) whose score times factor exceeds the least score of the hits."""
    least = hits.groupBy("query_id").agg(F.min("score").alias("least"), F.max(F.col("kind") == "table").alias("has"))
    more = tables.join(least.where("not has"), "query_id").where(F.col("score") * factor > F.col("least")).select("query_id", "id", "kind", "score")
    return hits.select("query_id", "id", "kind", "score").unionByName(more)
