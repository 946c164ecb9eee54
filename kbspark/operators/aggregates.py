"""Merges, counts, samples and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions.text import joined_paths, name_key


def split_duplicates(nodes: DataFrame, order: str) -> DataFrame:
    """A1: nodes(name, ...) with key, copies, representative (the first of its key); empty names go."""
    rows = nodes.withColumn("key", name_key(F.col("name"))).where("key <> ''")
    first = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min(order).alias("_first"))
    return rows.join(first, "key").withColumn("representative", F.col(order) == F.col("_first")).drop("_first")


def most_frequent(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of a key; ties: the one seen first."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("_c"), F.min(order).alias("_f"))
    return n.groupBy(*key).agg(F.max_by(value, F.struct("_c", -F.col("_f"))).alias(value))


def merge_nodes(mentions: DataFrame, fragments: int = 4) -> DataFrame:
    """A2: of mentions(name, type, description, chunk_id, path, position): name, type (most frequent, ties first seen),
    description (distinct ones, sorted, joined), sources, paths, needs_summary."""
    kind = most_frequent(mentions, ["name"], "type", "position")
    one = mentions.groupBy("name").agg(F.array_sort(F.collect_set("description")).alias("d"), F.array_sort(F.collect_set("chunk_id")).alias("sources"), F.array_sort(F.collect_set("path")).alias("p"))
    return one.join(kind, "name").select("name", "type", F.array_join("d", "<SEP>").alias("description"), "sources", joined_paths(F.col("p")).alias("paths"), (F.size("d") >= fragments).alias("needs_summary"))


def merge_edges(mentions: DataFrame) -> DataFrame:
    """A3: of mentions(src, dst, weight, description, keywords, chunk_id) per undirected pair: weight (sum), description
    and keywords (distinct parts, sorted), sources; self-loops go."""
    rows = mentions.where("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    parts = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.transform(F.split("keywords", ","), F.trim))), lambda x: x != "")))
    return rows.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"), F.array_join(parts, ",").alias("keywords"), F.array_sort(F.collect_set("chunk_id")).alias("sources")).withColumnsRenamed({"a": "src", "b": "dst"})


def created_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A3: ends of edges that are no nodes yet, of type UNKNOWN."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return ends.join(nodes.select("name"), "name", "left_anti").withColumn("type", F.lit("UNKNOWN"))


def group_relations(relations: DataFrame) -> DataFrame:
    """A4: directed groups of (src, dst, relation, type) with counts and A5 provenance."""
    return relations.groupBy("src", "dst", "relation", "type").agg(F.count("*").alias("n"), provenance(F.col("chunk_ids")).alias("chunk_ids"))


def provenance(ids: Column) -> Column:
    """A5: sorted distinct ids of the lists of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(ids))))


def type_distribution(nodes: DataFrame, top: int = 10) -> DataFrame:
    """Type, subtype, n: counts of both levels (null subtype: the whole type), the ``top`` subtypes of a type."""
    rows = nodes.select(F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("subtype", F.lit("Unknown")).alias("subtype"))
    n = rows.rollup("type", "subtype").agg(F.count("*").alias("n"), F.grouping("subtype").alias("g")).where("type is not null")
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy("type", "g").orderBy(F.desc("n"), "subtype")))
    return ranked.where((F.col("g") == 1) | (F.col("rank") <= top)).select("type", "subtype", "n")


def status_counts(docs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Status, n with zeros for absent ones and ``all``."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in statuses], "status string")
    n = docs.groupBy("status").agg(F.count("*").alias("n"))
    each = names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return each.unionByName(docs.agg(F.lit("all").alias("status"), F.count("*").alias("n")))


def occurrence_scores(hits: DataFrame, linked: DataFrame, k: int, similarity: float = 1.5, count: float = 1.0) -> DataFrame:
    """score = similarity * hit score + count * occurrences in linked(query_id, id), the k best a query."""
    n = linked.groupBy("query_id", "id").agg(F.count("*").alias("n"))
    out = hits.select("query_id", "id", "score").join(n, ["query_id", "id"], "full")
    score = F.round(F.coalesce("score", F.lit(0.0)) * similarity + F.coalesce("n", F.lit(0)) * count, 6)
    ranked = out.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def doc_index(owned: DataFrame, chunks: DataFrame) -> DataFrame:
    """A10: doc_id, names, n of owned(name, sources) by the documents of their chunks(chunk_id, doc_id)."""
    each = owned.select("name", F.explode("sources").alias("chunk_id")).join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "name").distinct()
    return each.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names")).withColumn("n", F.size("names"))


def merge_mappings(tables: DataFrame) -> DataFrame:
    """Of (position, canonical, olds): canonical, olds: the lists of a key put together in order, without repeats."""
    each = tables.select("canonical", "position", F.posexplode("olds").alias("at", "old"))
    first = each.groupBy("canonical", "old").agg(F.min(F.struct("position", "at")).alias("o"))
    return first.groupBy("canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "old"))), lambda x: x["old"]).alias("olds"))


def merge_attributes(rows: DataFrame, key: str, order: str, strategies: dict[str, str]) -> DataFrame:
    """One row a key; a column's strategy is concatenate, keep_first, keep_last, join_unique or max; empty values are
    passed over."""
    def one(c: str, how: str) -> Column:
        full = F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
        ordered = F.transform(F.array_sort(F.collect_list(F.when(full.isNotNull(), F.struct(order, F.col(c).cast("string").alias("v"))))), lambda x: x["v"])
        return {
            "concatenate": lambda: F.array_join(ordered, "\n"),
            "keep_first": lambda: F.min_by(full, F.when(full.isNotNull(), F.col(order))),
            "keep_last": lambda: F.max_by(full, F.when(full.isNotNull(), F.col(order))),
            "join_unique": lambda: F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(F.array_join(ordered, "<SEP>"), "<SEP>"), F.trim))), "<SEP>"),
            "max": lambda: F.max(full),
        }[how]().alias(c)

    return rows.groupBy(key).agg(*[one(c, how) for c, how in strategies.items()])


def evaluation_report(results: DataFrame) -> DataFrame:
    """Dataset (null: all), n, pass_rate, mean_score over judged rows, of results(dataset, passed, score)."""
    return results.groupingSets([["dataset"], []], "dataset").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def tree_counts(paths: DataFrame) -> DataFrame:
    """Depth (null: all), names, paths of distinct prefixes of paths(path array)."""
    each = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth")).select("depth", F.array_join(F.slice("path", F.lit(1), F.col("depth")), "/").alias("p"), F.get("path", F.col("depth") - 1).alias("name")).distinct()
    return each.groupingSets([["depth"], []], "depth").agg(F.countDistinct("name").alias("names"), F.countDistinct("p").alias("paths"))


def column_samples(rows: DataFrame, columns: list[str], order: str, n: int = 5) -> DataFrame:
    """Column, samples: the first n distinct values that are not null of each column."""
    long = rows.select(order, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(order, "x.*").where("value is not null")
    first = long.groupBy("column", "value").agg(F.min(order).alias("o"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy("o", "value"))).where(F.col("rank") <= n)
    return ranked.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    """source_id, chunk_ids, n, largest first."""
    return chunks.groupBy("source_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"), F.count("*").alias("n")).orderBy(F.desc("n"), "source_id")


def filled_table(grid: DataFrame, answers: DataFrame, metrics: list[str]) -> DataFrame:
    """Entity, time, a column a metric: the last of answers(task_id, position, value) in each cell, empty if there is none."""
    last = answers.groupBy("task_id").agg(F.max_by("value", "position").alias("value"))
    return grid.join(last, "task_id", "left").groupBy("entity", "time").pivot("metric", metrics).agg(F.first(F.coalesce("value", F.lit(""))))


def rebuilt_nodes(mentions: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged nodes of the mentions outside removed(chunk_id), names that have none left); of a (chunk, name) the
    first mention counts: by position, then by place where there is one, then by the other columns."""
    kept = mentions.join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti")
    order = [c for c in ("position", "place") if c in kept.columns]
    first = kept.groupBy("chunk_id", "name").agg(F.min(F.struct(*order, *[c for c in kept.columns if c not in ("chunk_id", "name", *order)])).alias("r")).select("chunk_id", "name", "r.*")
    return merge_nodes(first), mentions.select("name").distinct().join(kept.select("name").distinct(), "name", "left_anti")


def labels(nodes: DataFrame) -> DataFrame:
    """A19."""
    return nodes.select("name").distinct().orderBy("name")


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Table, position, column, type, rows."""
    spark = df.sparkSession
    columns = spark.createDataFrame([(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "table string, position int, column string, type string")
    return columns.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))
