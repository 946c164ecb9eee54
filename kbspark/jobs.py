"""Cutting lineage in the shared folder, and connected components, as DataFrame jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set and Spark runs in one process, as in tests, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = getattr(spark, "_own_shared_dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark._own_shared_dir = found
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Python tasks get 2000 rows at once, unless another number was set: whole texts are large rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it: later stages survive lost executors and it is made once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again; Spark deletes shuffles of finished steps once the driver collects
    its garbage, which else may be long after."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        spark._jvm.System.gc()


MOST_BYTES = 64 << 20  # of a table that is broadcast, about


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    out = F.lit(0).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            out += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            out += F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
        else:
            out += 8
    return out


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A table to be broadcast if it is counted to have at most ``rows`` and MOST_BYTES; else it is joined by shuffling."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= MOST_BYTES else df


TASK_ROWS = 1 << 20  # that a task groups or sorts, about


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df shuffled by keys to so many partitions that tasks do not grow with it; for keys that hardly repeat, which gain
    nothing by being summed before the shuffle. rows: how many there are, where that is known."""
    n = df.count() if rows is None else rows
    return df if n <= TASK_ROWS else df.repartition(max(partitions(df.sparkSession), -(-n // TASK_ROWS)), *keys)


SALTS = 16


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join with a table that has one row a key; the rows of a hot key are spread over SALTS tasks by a column."""
    salted = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


CONTRACTED = 1 << 20  # edges that a task contracts at once


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) with those of a task joined: each node with the smallest node that its edges here reach."""

    def stars(got: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(got).combine_chunks()
        ends = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).combine_chunks()
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        code = pc.index_in(ends, value_set=names).to_numpy()
        u, v = code[: t.num_rows], code[t.num_rows :]
        root = np.arange(len(names))
        while True:
            least = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], least)
            np.minimum.at(new, root[v], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        keep = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(keep)), names.take(pa.array(root[keep]))], ["u", "v"])

    got, n = [], 0
    for batch in batches:
        got.append(batch)
        n += batch.num_rows
        if n >= CONTRACTED:
            yield stars(got)
            got, n = [], 0
    if n:
        yield stars(got)


HUB = 1000  # edges of a node beyond which its rows are not shuffled


def _with_least(rows: DataFrame, both: DataFrame) -> DataFrame:
    """u, v, m of rows(u, v): m is the smallest of u and what edges both(u, v) lead to from it. Rows of hubs, of which there
    are few, meet a broadcast table; the others are joined by shuffling."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = sized(least.where(F.col("n") > HUB).select("u", F.col("m").alias("h")))
    marked = rows.join(hubs, "u", "left")
    return marked.where("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(marked.where("h is null").select("u", "v").join(least.select("u", "m"), "u"))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links``; component is the smallest node that links reach.

    Alternates large-star and small-star contractions, which are grouped minima and equi-joins, until
    every node points straight at its root; before each, tasks contract the edges that they hold. Only counts
    come to the driver.
    """
    joined = lambda df: df.mapInArrow(_contracted, df.schema).distinct()
    edges = settle(joined(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")), "edges")
    for _ in range(rounds):
        # a forest of stars: each u has one v, and no v is a u
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if open_.isEmpty():
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both.where("v > u"), both).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, edges = edges, settle(joined(small.where("u > v")), "edges")
        release(last)
    raise RuntimeError(f"components did not settle within {rounds} rounds")
