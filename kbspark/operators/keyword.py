"""Keyword search by an inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions.text import index_tokens
from kbspark.jobs import settle

K1, B = 1.5, 0.75
BLOCK = 64  # postings
SHARD = 16_384  # chunks that are searched at once
EPS = 1e-6  # scores are rounded to six digits
MOST_ASKED = 500_000  # (query, token) rows that are shipped


def inverted_index(chunks: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(token, id, tf, size) of chunks(id, text)."""
    each = chunks.select("id", F.explode(tokens if tokens is not None else index_tokens(F.col("text"))).alias("token"))
    tf = each.groupBy("id", "token").agg(F.count("*").alias("tf"))
    sizes = each.groupBy("id").agg(F.count("*").alias("size"))
    return tf.join(sizes, "id").select("token", "id", "tf", "size")


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int, match: str = "all", tokens: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: BM25 of chunks(id, text) for queries(query_id, text); ``all``: only chunks that hold
    every query token. Rounded to 6 digits, ties by id.

    Up to MOST_ASKED query tokens are shipped: one pass counts them in each chunk, a second searches shards of counted
    chunks by impact-ordered blocks (``Postings``) and keeps k a query and task, so only those are shuffled. More
    are joined with the postings of the chunks.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("text")))).alias("token")).distinct()
    each = chunks.select("id", (tokens if tokens is not None else index_tokens(F.col("text"))).alias("t")).where("size(t) > 0")
    if asked.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        hits = _by_postings(asked, each, match)
    else:
        hits = _by_chunks(asked, each, k, match)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def _by_postings(asked: DataFrame, each: DataFrame, match: str) -> DataFrame:
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    stats = each.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))  # one row
    postings = each.select("id", F.size("t").alias("size"), F.explode("t").alias("token")).join(asked.select("token").distinct(), "token", "left_semi").groupBy("token", "id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    scored = postings.join(df, "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    hits = asked.join(scored.select("token", "id", weight.alias("weight")), "token").groupBy("query_id", "id").agg(F.sum("weight").alias("score"), F.count("*").alias("found"))
    if match == "all":
        hits = hits.join(wanted, "query_id").where("found = wanted")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


def _counted(shipped):
    """Of chunks(id, t), how often each shipped token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shipped.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            at = pc.index_in(lists.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(batch.num_rows), size)
            cell, tf = np.unique(row[at >= 0] * (len(names) + 1) + at[at >= 0], return_counts=True)
            ends = np.searchsorted(cell, np.arange(batch.num_rows + 1) * (len(names) + 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), listed(cell % (len(names) + 1)), listed(tf)], ["id", "size", "token", "tf"])

    return run


class Postings:
    """Impact-ordered postings of a shard of counted chunks: a list a token, by falling weight, in blocks of BLOCK.

    A block's upper bound is its first weight. A query reads the blocks of its lists by falling bounds, and stops when the
    bounds of the first unread block of each list sum to less than the k-th score: what was not met cannot enter.
    Chunks that were met, and could enter with the unread bounds, are scored whole from their own tokens.
    """

    def __init__(self, ids: np.ndarray, size: np.ndarray, ends: np.ndarray, token: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float, block: int = BLOCK):
        self.ids, self.ends, self.token = ids, ends, token
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        self.weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
        order = np.lexsort((-self.weight, token))
        self.row, self.impact, listed = row[order], self.weight[order], token[order]
        self.first = np.searchsorted(listed, np.arange(len(idf) + 1))
        place = np.arange(len(order)) - self.first[listed]
        self.opens = np.flatnonzero(place % block == 0)
        self.bound = self.impact[self.opens]
        self.of = np.searchsorted(self.opens, self.first)  # the first block of each list
        last = np.append(listed[self.opens][1:], -1) != listed[self.opens]
        self.next = np.where(last, 0.0, np.append(self.bound[1:], 0.0))
        self.to = np.append(self.opens[1:], len(order))
        self.marked = np.zeros(len(idf), bool)
        self.read = self.there = 0

    def _runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())

    def exact(self, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of chunks, and how many of the tokens each has."""
        self.marked[tokens] = True
        at = self._runs(self.ends[rows], self.ends[rows + 1])
        own = np.repeat(np.arange(len(rows)), self.ends[rows + 1] - self.ends[rows])
        hit = self.marked[self.token[at]]
        self.marked[tokens] = False
        return np.round(np.bincount(own[hit], self.weight[at[hit]], len(rows)), 6), np.bincount(own[hit], minlength=len(rows))

    def search(self, tokens: np.ndarray, k: int, floor: float, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the shard's chunks that may be among the k best, none below floor; wanted: those with so many of the tokens."""
        self.there += int((self.first[tokens + 1] - self.first[tokens]).sum())
        if wanted is not None:  # chunks with all tokens are in the shortest list
            if len(tokens) < wanted:
                return np.zeros(0), np.zeros(0, np.int64)
            short = tokens[np.argmin(self.first[tokens + 1] - self.first[tokens])]
            rows = self.row[self.first[short] : self.first[short + 1]]
            self.read += len(rows)
            score, found = self.exact(rows, tokens)
            keep = (found == wanted) & (score >= floor)
            return score[keep], self.ids[rows[keep]]
        blocks = self._runs(self.of[tokens], self.of[tokens + 1])
        if not len(blocks):
            return np.zeros(0), np.zeros(0, np.int64)
        blocks = blocks[np.argsort(-self.bound[blocks], kind="stable")]
        # what unread blocks can add after each block is read
        unread = self.bound[self.of[tokens[self.first[tokens + 1] > self.first[tokens]]]].sum() - np.cumsum(self.bound[blocks] - self.next[blocks])
        partial = np.zeros(len(self.ids))
        done, low = 0, floor
        upto = int(np.searchsorted(-unread, -low, "right")) + 1 if low > 0 else min(len(blocks), 2 * len(tokens))
        while True:
            upto = min(upto, len(blocks))
            at = self._runs(self.opens[blocks[done:upto]], self.to[blocks[done:upto]])
            self.read += len(at)
            partial += np.bincount(self.row[at], self.impact[at], len(partial))
            done = upto
            if done == len(blocks) or unread[done - 1] < low - EPS:
                break
            met = np.flatnonzero(partial)
            if len(met) >= k:  # the best so far, scored whole, give a k-th score
                best = met[np.argpartition(-partial[met], k - 1)[: 2 * k]]
                low = max(low, float(np.partition(self.exact(best, tokens)[0], len(best) - k)[len(best) - k]))
            upto = max(done + len(tokens), int(np.searchsorted(-unread, -(low - EPS), "right")) + 1)
        rows = np.flatnonzero((partial > 0) & (partial + max(unread[done - 1], 0) >= low - EPS))
        self.read += len(rows)
        score, _ = self.exact(rows, tokens)
        keep = score >= low
        return score[keep], self.ids[rows[keep]]


def _scored(shipped, k: int, match: str):
    """The k best of a task's counted chunks for each query, shard by shard. ``first``: where the tokens of a query begin in ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, first, of, idf, mean = shipped.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)

        def shard(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(t["token"]).to_numpy())])
            flat = lambda c: t[c].combine_chunks().flatten().to_numpy()
            own = Postings(t["id"].to_numpy(), t["size"].to_numpy(), ends, flat("token"), flat("tf"), idf, mean)
            for q in range(len(names)):
                score, ids = best[q]
                new = own.search(of[first[q] : first[q + 1]], k, score[-1] if len(score) == k else 0.0, wanted[q] if match == "all" else None)
                if len(new[0]):
                    score, ids = np.concatenate([score, new[0]]), np.concatenate([ids, new[1]])
                    order = np.lexsort((ids, -score))[:k]
                    best[q] = score[order], ids[order]

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SHARD:
                shard(held)
                held, n = [], 0
        if n:
            shard(held)
        for s in range(0, len(names), 1024):
            part = best[s : s + 1024]
            if any(len(x[0]) for x in part):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[s : s + 1024], [len(x[0]) for x in part])), pa.array(np.concatenate([x[1] for x in part])), pa.array(np.concatenate([x[0] for x in part]))], ["query_id", "id", "score"])

    return run


def _by_chunks(asked: DataFrame, each: DataFrame, k: int, match: str) -> DataFrame:
    spark = each.sparkSession
    pairs = asked.toArrow()  # at most MOST_ASKED rows
    names, query = np.unique(pairs["query_id"].to_numpy(), return_inverse=True)
    words, token = np.unique(np.array(pairs["token"].to_pylist(), object).astype(str), return_inverse=True)
    counted = settle(each.mapInArrow(_counted(spark.sparkContext.broadcast(words.tolist())), "id long, size long, token array<int>, tf array<int>"), "keyword-counts")
    n, mean = counted.agg(F.count("*"), F.avg("size")).first()
    df = np.zeros(len(words))
    seen = counted.select(F.explode("token").alias("token")).groupBy("token").agg(F.count("*").alias("df")).toArrow()  # at most a row a query token
    df[seen["token"].to_numpy()] = seen["df"].to_numpy()
    order = np.lexsort((token, query))
    first = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(names)))])
    shipped = spark.sparkContext.broadcast((names, np.bincount(query, minlength=len(names)), first, token[order], np.log(1 + (n - df + 0.5) / (df + 0.5)), mean))
    return counted.where("size(token) > 0").mapInArrow(_scored(shipped, k, match), "query_id long, id long, score double")


def triple_topk(queries: DataFrame, triples: DataFrame, k: int = 5) -> DataFrame:
    """BM25 over triples(id, source, relation, destination) whose fields are whole tokens; queries are split at blanks."""
    fields = F.transform(F.array("source", "relation", "destination"), F.lower)
    return keyword_topk(queries, triples, k, "any", fields)
