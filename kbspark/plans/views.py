"""Derived tables of the driver's star schema: chunks, graph, memory, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.chunking import stride_chunks

SIZE, OVERLAP = 128, 32


class Tables:
    """The tables of a folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def chunks(t: Tables) -> DataFrame:
    """id (doc_id * 10,000,000 + chunk_order), doc_id, chunk_order, tokens, text."""
    return stride_chunks(t.documents, SIZE, OVERLAP).withColumn("id", F.col("doc_id") * 10_000_000 + F.col("chunk_order"))


CHUNKS = """w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
cuts AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 96)) AS pos FROM w WHERE len(w) > 0),
chunks AS (SELECT doc_id, CAST(pos // 96 AS BIGINT) AS chunk_order, CAST(len(list_slice(w, pos + 1, pos + 128)) AS BIGINT) AS tokens, array_to_string(list_slice(w, pos + 1, pos + 128), ' ') AS text, doc_id * 10000000 + pos // 96 AS id FROM cuts)"""


def mentions(t: Tables) -> DataFrame:
    """One row a line item: the part's name, type, brand, the order as its chunk. Lines repeat positions; ``place``, the row's
    own in the table, tells which of them is first."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"))
    rows = t.lineitem.withColumn("place", F.struct("_metadata.file_name", "_metadata.row_index")).join(p, "l_partkey")
    return rows.select("name", "type", "description", F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_returnflag").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), "place")


MENTIONS = "mentions AS (SELECT p_name AS name, p_type AS type, p_brand AS description, CAST(l_orderkey AS VARCHAR) AS chunk_id, l_returnflag AS path, l_orderkey * 10 + l_linenumber AS position FROM lineitem JOIN part ON l_partkey = p_partkey)"


def edges(t: Tables) -> DataFrame:
    """Part-supplier edges of line items: src p<key>, dst s<key>, weight, relation, edge_id."""
    return t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("keywords"), F.col("l_shipdate").cast("date").cast("string").alias("description"), F.col("l_orderkey").cast("string").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"))


EDGES = "edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_quantity AS weight, l_returnflag AS relation, l_linestatus AS keywords, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS description, CAST(l_orderkey AS VARCHAR) AS chunk_id, l_orderkey * 10 + l_linenumber AS edge_id FROM lineitem)"


def nodes(t: Tables) -> DataFrame:
    """Parts and suppliers as nodes: node, name, type, subtype, position."""
    p = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("subtype"), F.col("p_partkey").alias("position"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.lit(None).cast("string").alias("subtype"), (F.col("s_suppkey") + 1_000_000_000).alias("position"))
    return p.unionByName(s)


NODES = "nodes AS (SELECT 'p' || p_partkey AS node, p_name AS name, p_type AS type, p_brand AS subtype, p_partkey AS position FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', NULL, s_suppkey + 1000000000 FROM supplier)"


def memory_events(t: Tables) -> DataFrame:
    """The event table as changes: signup ADD, click and view UPDATE, error DELETE, purchase NONE."""
    kind = F.when(F.col("event_type") == "signup", "ADD").when(F.col("event_type").isin("click", "view"), "UPDATE").when(F.col("event_type") == "error", "DELETE").otherwise("NONE")
    return t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("memory_id"), kind.alias("event"), F.col("event_type").alias("text"))


EVENTS = "ev AS (SELECT event_id AS seq, user_id AS memory_id, CASE WHEN event_type = 'signup' THEN 'ADD' WHEN event_type IN ('click', 'view') THEN 'UPDATE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'NONE' END AS event, event_type AS text FROM events)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("dataset"), F.concat(F.lit("n"), F.col("vec_id") % 97).alias("name"))


def vector_queries(t: Tables) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def statuses(t: Tables) -> DataFrame:
    """Orders as document states."""
    s = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), s.alias("status"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("created_at"))


STATUS = "st AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_totalprice AS size, o_orderdate AS created_at FROM orders)"
