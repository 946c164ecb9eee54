"""Composite retrieval (Q1-Q4, Q6, Q7), each a plan over tables of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text
from kbspark.jobs import settle
from kbspark.operators import aggregates, graph, joins, keyword, ranking, tables, vectors


CANDIDATES = 1000  # nearest chunks that are scored


def naive_hybrid(queries: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, lineage: DataFrame, k: int, similarity: float = 1.5, count: float = 1.0) -> DataFrame:
    """Q1: the CANDIDATES nearest of chunks(id, embedding), and chunks that the nearest entities(id, embedding) and
    relations(id, embedding), half of k each, own by lineage(owner_id, chunk_id); scored by similarity and by how many
    of those own them; the k best a query. Ids of entities and relations differ."""
    hits = vectors.topk(queries, chunks, CANDIDATES).select("query_id", "id", "score")
    owners = vectors.topk(queries, entities, max(1, k // 2)).unionByName(vectors.topk(queries, relations, max(1, k - k // 2))).select("query_id", F.col("id").alias("owner_id"))
    linked = joins.chunks_of(owners, lineage.select("owner_id", F.col("chunk_id").alias("id"))).select("query_id", "id")
    return aggregates.occurrence_scores(hits, linked, k, similarity, count)


def hybrid_rerank(queries: DataFrame, chunks: DataFrame, linked: DataFrame, k: int, depth: int = 200, scores: DataFrame | None = None) -> DataFrame:
    """Q2: ranks of vectors and of keywords of chunks(id, text, embedding) fused, linked chunks boosted, reranked by external
    scores if there are any."""
    by_vector = vectors.topk(queries.select("query_id", "embedding"), chunks.select("id", "embedding"), depth)
    by_word = keyword.keyword_topk(queries.select("query_id", "text"), chunks.select("id", "text"), depth, "any")
    lists = by_vector.select("query_id", F.lit(0).alias("list"), "id", "rank").unionByName(by_word.select("query_id", F.lit(1).alias("list"), "id", "rank"))
    fused = ranking.boost_linked(ranking.fuse_ranks(lists), linked, k)
    if scores is None:
        return fused.where(F.col("rank") <= k)
    return ranking.rerank(fused.drop("rank"), scores, k)


def multi_variation(variations: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Q3: the keyword hits of all phrasings(query_id, variation, text) of a query, the first of equal texts."""
    keyed = variations.withColumn("_q", F.col("query_id") * 10 + F.col("variation"))
    hits = keyword.keyword_topk(keyed.select(F.col("_q").alias("query_id"), "text"), chunks.select("id", "text"), k, "any")
    rows = hits.join(chunks.select("id", "text"), "id").select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10 * 1_000_000 + F.col("rank")).alias("rank"), "id", "text")
    return ranking.union_first(rows)


def multi_hop(seeds: DataFrame, edges: DataFrame, rounds: int = 3, most: int = 20) -> DataFrame:
    """Q4: query_id, node, round: what edges lead to from seeds(query_id, node) in at most ``rounds`` rounds, up to ``most``
    edges a node and round; nodes that were seen are not gone through again. The adjacency is cut to ``most`` once.
    Queries go by blocks (``graph.hops``); those whose lists a task could not hold go by pairs of queries and nodes."""
    near = joins.capped_adjacency(edges.select("edge_id", "src", "dst"), most).select("node", F.when(F.col("src") == F.col("node"), F.col("dst")).otherwise(F.col("src")).alias("other")).where("node <> other")
    seeds = settle(seeds.select("query_id", "node").distinct(), "seeds")
    lists = sum(most**n for n in range(rounds))  # of a seed, at most
    wide = seeds.groupBy("query_id").count().where(F.col("count") * lists > graph.LISTS).select("query_id")
    wide = settle(wide, "wide-queries")
    if wide.isEmpty():
        return graph.hops(seeds, near, rounds, most)
    near, same = settle(near, "adjacency"), seeds["query_id"].eqNullSafe(wide["query_id"])
    few = graph.hops(settle(seeds.join(wide, same, "left_anti"), "seeds"), near, rounds, most)
    return few.unionByName(_hops_by_pairs(seeds.join(wide, same, "left_semi"), near.withColumnsRenamed({"node": "from", "other": "node"}), rounds))


def _hops_by_pairs(seeds: DataFrame, near: DataFrame, rounds: int) -> DataFrame:
    seen = seeds.withColumn("round", F.lit(0))
    front = seen
    for n in range(1, rounds + 1):
        ends = front.select("query_id", F.col("node").alias("from")).join(near, "from").select("query_id", "node").distinct()
        front = settle(ends.join(seen, ["query_id", "node"], "left_anti").withColumn("round", F.lit(n)), "hop")
        seen = seen.unionByName(front)
    return seen


def generated_table(grid: DataFrame, answers: Callable[[DataFrame], DataFrame], metrics: list[str]) -> DataFrame:
    """Q6: ask a question a task of the grid, fill the table by the answers(task_id, position, value)."""
    return aggregates.filled_table(grid, answers(tables.questions(grid)), metrics)


def retrieved_answers(asked: DataFrame, embed: Callable[[DataFrame], DataFrame], chunks: DataFrame, answer: Callable[[DataFrame, DataFrame], DataFrame], k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Q6: answers of questions by retrieval: embed(questions) gives (task_id, embedding), of chunks(id, embedding, text) the k
    nearest by cosine above the threshold are contexts(task_id, rank, score, text), and answer(questions, contexts)
    gives (task_id, position, value)."""
    vectors_ = embed(asked).select(F.col("task_id").alias("query_id"), "embedding")
    hits = settle(vectors.topk(vectors_, chunks, k, cosine=True, floor=threshold), "table-hits")
    contexts = hits.join(chunks.select("id", "text"), "id").select(F.col("query_id").alias("task_id"), "rank", "score", "text")
    return answer(asked, contexts)


def queried_table(filled: DataFrame, metrics: list[str], sql: Callable[[str], str]) -> DataFrame:
    """Q6: a filled table with its metrics as numbers (P4; null where a cell is none), asked by guarded SQL (P18); sql gets the
    name under which the table can be read."""
    name = f"table_{uuid.uuid4().hex}"
    typed = filled.select(*[c for c in filled.columns if c not in metrics], *[text.parse_number(F.col(m)).alias(m) for m in metrics])
    settle(typed, "table").createOrReplaceTempView(name)
    try:
        return tables.guarded_sql(filled.sparkSession, sql(name))
    finally:
        filled.sparkSession.catalog.dropTempView(name)


def layered(queries: DataFrame, *stores: DataFrame, least: float = 0.0) -> DataFrame:
    """Q7: results(query_id, id, score) of the first store that has any of at least ``least`` for a query."""
    out, left = None, queries.select("query_id")
    for i, store in enumerate(stores):
        hit = store.where(F.col("score") >= least).join(left, "query_id", "left_semi").withColumn("store", F.lit(i))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return out
