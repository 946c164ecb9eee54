"""Ranking, budgets, windows and ordered set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.jobs import settle


def first_of(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def fuse_ranks(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, score: the sum of 1 / (k + rank) over lists(query_id, list, id, rank)."""
    return lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def boost_linked(fused: DataFrame, linked: DataFrame, top_k: int, k: int = 60) -> DataFrame:
    """Fused scores plus count / k of linked(query_id, id); the best min(3 top_k, 50) a query."""
    n = linked.groupBy("query_id", "id").agg(F.count("*").alias("n"))
    out = fused.join(n, ["query_id", "id"], "full").select("query_id", "id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("n", F.lit(0)) / k, 9).alias("score"))
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= min(3 * top_k, 50))


def rerank(fused: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """Order by external scores(query_id, id, rerank); where there is none, by the fused score, after those that have one."""
    out = fused.join(scores, ["query_id", "id"], "left")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= most).select("query_id", "id", "score", "rerank", "rank")


def interleave(lists: DataFrame) -> DataFrame:
    """lists(query_id, list, rank, id) in turns: all first ranks, then all second; a repeated id counts where it came first."""
    once = first_of(lists, ["query_id", "id"], "rank", "list")
    return once.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "list", "id"))).select("query_id", "id", "position")


def within_budget(rows: DataFrame, group: list[str], order: list, tokens: str, budget) -> DataFrame:
    """Rows while the running sum of tokens stays within the budget; the first that exceeds it ends its group."""
    total = F.sum(tokens).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", total).where(F.col("used") <= budget)


def finish_chunks(chunks: DataFrame, least: float, top_k: int, budget: int) -> DataFrame:
    """Of chunks(query_id, id, rerank, tokens), those of at least ``least``, the best top_k, within the token budget."""
    kept = chunks.where(F.coalesce("rerank", F.lit(least)) >= least).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "id")))
    return within_budget(kept.where(F.col("rank") <= top_k), ["query_id"], ["rank"], "tokens", budget)


def poll_weighted(owned: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Of owned(query_id, owner_rank, chunk_rank, id), each owner's first chunks by a quota that falls linearly from
    most (first owner) to least (last); what owners leave unused goes to the next unused chunks in owner order."""
    owners = owned.groupBy("query_id", "owner_rank").agg(F.count("*").alias("has"))
    per = W.partitionBy("query_id").orderBy("owner_rank")
    owners = owners.withColumn("i", F.row_number().over(per) - 1).withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    quota = F.when(F.col("n") == 1, F.lit(most)).otherwise(F.bround(F.lit(float(most)) - F.col("i") / (F.col("n") - 1) * (most - least)).cast("int"))
    owners = owners.withColumn("quota", quota).withColumn("spare", F.when(F.col("n") == 1, 0).otherwise(F.greatest(F.col("quota") - F.col("has"), F.lit(0))))
    owners = owners.withColumn("left", F.sum("spare").over(W.partitionBy("query_id")))
    owners = settle(owners, "owners")
    most_each = owners.agg(F.max(F.col("quota") + F.col("left"))).first()[0] or 0  # no owner gives more
    rows = owned.withColumn("place", F.row_number().over(W.partitionBy("query_id", "owner_rank").orderBy("chunk_rank", "id"))).where(F.col("place") <= most_each)
    rows = rows.join(owners.select("query_id", "owner_rank", "quota", "left"), ["query_id", "owner_rank"])
    rows = rows.withColumn("own", F.col("place") <= F.col("quota"))
    extra = F.row_number().over(W.partitionBy("query_id", "own").orderBy("owner_rank", "place"))
    rows = rows.withColumn("extra", extra).where(F.col("own") | (F.col("extra") <= F.col("left")))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("own"), "owner_rank", "place"))
    return rows.withColumn("position", order).select("query_id", "owner_rank", "id", "position")


def first_owner(owned: DataFrame) -> DataFrame:
    """Of owned(query_id, owner_rank, id), each chunk with its earliest owner and its number of owners; within an
    owner the chunks with more owners come first."""
    each = owned.groupBy("query_id", "id").agg(F.min("owner_rank").alias("owner_rank"), F.count("*").alias("times"))
    return each.withColumn("chunk_rank", F.row_number().over(W.partitionBy("query_id", "owner_rank").orderBy(F.desc("times"), "id")))


def last_messages(messages: DataFrame, k: int = 10) -> DataFrame:
    """The last k messages(conv_id, turn, ...) of each conversation."""
    return messages.withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= k).drop("_n")


def turn_pairs(messages: DataFrame, n: int) -> DataFrame:
    """conv_id, pair, user, assistant: messages(conv_id, turn, role, text) of user and assistant two by two in order;
    pairs of one role are not valid; the last n valid ones of a conversation."""
    rows = messages.where(F.col("role").isin("user", "assistant")).withColumn("pair", F.floor((F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1) / 2))
    pairs = rows.groupBy("conv_id", "pair").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant"), F.count("*").alias("n"))
    valid = pairs.where("n = 2 and user is not null and assistant is not null")
    return valid.withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("pair")))).where(F.col("_n") <= n).select("conv_id", "pair", "user", "assistant")


def edge_ranking(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Distinct undirected edges(src, dst, weight) by the sum of their ends' degrees, then weight."""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    d = degrees.select("node", "degree")
    out = one.join(d.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src", "left").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst", "left")
    return out.select("src", "dst", "weight", (F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("rank"))


def hubs(degrees: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The n nodes of highest degree that exist."""
    return degrees.join(nodes.select("node"), "node", "left_semi").orderBy(F.desc("degree"), "node").limit(n)


def hierarchy_sample(edges: DataFrame, kinds: list[str], n: int) -> DataFrame:
    """The first n distinct pairs of edges(src, dst, relation) of some relations."""
    return edges.where(F.col("relation").isin(*kinds)).select("src", "dst", "relation").distinct().orderBy("relation", "src", "dst").limit(n)


def page_of(rows: DataFrame, page: int, size: int, sort: str, allowed: tuple[str, ...], key: str, descending: bool = False) -> DataFrame:
    """A page (page >= 1, size within 10-200) with total, pages, has_next and has_prev on each row."""
    page, size = max(1, page), min(200, max(10, size))
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    cut = rows.orderBy(F.desc(sort) if descending else F.asc(sort), key).offset((page - 1) * size).limit(size)
    return cut.crossJoin(F.broadcast(total)).withColumn("has_next", F.lit(page) < F.col("pages")).withColumn("has_prev", F.lit(page > 1))


def history_of(history: DataFrame, memory_ids: DataFrame) -> DataFrame:
    """History rows of some memories by creation, then update."""
    return history.join(memory_ids.select("memory_id").distinct(), "memory_id", "left_semi").orderBy("memory_id", "created_at", "updated_at")


def fill_down(rows: DataFrame, group: list[str], order: str, levels: list[str]) -> DataFrame:
    """Empty cells take the value above; a level starts anew where one before it has a new value of its own."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    cell = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    out, before = rows, []
    for c in levels:
        scope = F.sum(F.when(F.coalesce(*[cell(b).isNotNull() for b in before], F.lit(False)), 1).otherwise(0)).over(w) if before else F.lit(0)
        out = out.withColumn(f"_s_{c}", scope)
        before.append(c)
    for c in levels:
        per = W.partitionBy(*group, f"_s_{c}").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(f"_f_{c}", F.last(cell(c), ignorenulls=True).over(per))
    kept = [c for c in rows.columns if c not in levels]
    return out.select(*kept, *[F.col(f"_f_{c}").alias(c) for c in levels])


def final_context(entities: DataFrame, relations: DataFrame, chunks: DataFrame, entity_budget: int = 6000, relation_budget: int = 8000, total: int = 30000) -> DataFrame:
    """query_id, kind, id, rank: (query_id, id, rank, tokens) tables cut at their budgets; chunks get what is left."""
    parts = [within_budget(t, ["query_id"], ["rank", "id"], "tokens", b).select("query_id", F.lit(k).alias("kind"), "id", "rank", "tokens") for t, k, b in ((entities, "entity", entity_budget), (relations, "relation", relation_budget))]
    both = parts[0].unionByName(parts[1])
    used = both.groupBy("query_id").agg(F.sum("tokens").alias("used_by"))
    rest = chunks.join(used, "query_id", "left").withColumn("room", F.lit(total) - F.coalesce("used_by", F.lit(0)))
    rest = within_budget(rest, ["query_id"], ["rank", "id"], "tokens", F.col("room")).select("query_id", F.lit("chunk").alias("kind"), "id", "rank", "tokens")
    return both.unionByName(rest)


def union_first(*lists: DataFrame) -> DataFrame:
    """O1: results(query_id, rank, text) of datasets or variations, the first of equal texts, numbered anew."""
    out = lists[0].withColumn("_l", F.lit(0))
    for i, other in enumerate(lists[1:], 1):
        out = out.unionByName(other.withColumn("_l", F.lit(i)))
    once = first_of(out, ["query_id", "text"], "_l", "rank")
    # texts are put in order only among equal ranks, so that the order of a whole query does without them
    tied = once.withColumn("_t", F.row_number().over(W.partitionBy("query_id", "_l", "rank").orderBy("text")))
    return tied.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_l", "rank", "_t"))).drop("_l", "_t")


def incident_distinct(outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """O2."""
    return outgoing.unionByName(incoming).distinct()


def source_difference(owned: DataFrame, removed: DataFrame) -> DataFrame:
    """O3: (key, sources, action): owned(key, sources) without removed(source); none left: delete, fewer: rebuild, else keep."""
    each = owned.select("key", F.explode_outer("sources").alias("source"))
    left = each.join(removed.select("source").distinct().withColumn("gone", F.lit(True)), "source", "left").groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("gone").isNull(), F.col("source")))).alias("sources"), F.max(F.coalesce("gone", F.lit(False))).alias("hit"))
    return left.select("key", "sources", F.when(F.size("sources") == 0, "delete").when(F.col("hit"), "rebuild").otherwise("keep").alias("action"))


def ordered_distinct(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return first_of(rows, key, order)


def unoccupied(new: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """New rows whose key neither exists nor repeats an earlier one."""
    return first_of(new.join(existing.select(*key).distinct(), key, "left_anti"), key, order)


def overlap(sets: DataFrame, other: DataFrame) -> DataFrame:
    """(key, common) of sets(key, ids) and other(id): how many ids are in both, where any is."""
    return sets.select("key", F.explode(F.array_distinct("ids")).alias("id")).join(other.select("id").distinct(), "id", "left_semi").groupBy("key").agg(F.count("*").alias("common"))


def citations(hits: DataFrame) -> DataFrame:
    """Q5: hits(query_id, rank, dataset, source) with ``number``, that of their distinct (dataset, source) in hit order from 1."""
    first = hits.groupBy("query_id", "dataset", "source").agg(F.min("rank").alias("first"))
    numbered = first.withColumn("number", F.row_number().over(W.partitionBy("query_id").orderBy("first", "dataset", "source"))).drop("first")
    return hits.join(numbered, ["query_id", "dataset", "source"])
