"""Scans and sinks of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.text import strip
from kbspark.jobs import settle, sized

# Routes of file extensions.
ROUTES = {
    "doc": ("pdf", "doc", "docx", "ppt", "pptx"),
    "html": ("html", "htm"),
    "image": ("jpg", "jpeg", "png", "bmp", "gif", "webp"),
    "text": ("txt", "text", "md", "markdown"),
    "sheet": ("csv", "xls", "xlsx", "ods"),
}
#: Columns that other writers name otherwise.
ALIASES = {"Id": ("Id", "id"), "chunk_id": ("chunk_id", "ChunkId", "chunkid"), "text": ("text", "Text"), "name": ("name", "NodeName", "nodename")}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines; blank lines are neither."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select(F.col("value").alias("line"))


def with_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns under their usual names; the first one that is there and not null counts."""
    for name, others in aliases.items():
        found = [o for o in others if o in df.columns]
        if found:
            value = F.coalesce(*[F.col(f"`{o}`") for o in found])
            df = df.withColumn("_value", value).drop(*found).withColumnRenamed("_value", name)
    return df


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: a CSV file with a header, all text; malformed rows go, nulls are empty; blank names become ``_``."""
    df = spark.read.csv(path, header=True, inferSchema=False, mode="DROPMALFORMED", enforceSchema=False)
    return df.toDF(*[c.strip() or "_" for c in df.columns]).na.fill("")


def read_declared_table(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(name, number or other) columns; empty is null; text in a number column is null."""
    df = read_text_table(spark, path)
    value = lambda c: F.when(F.col(f"`{c}`") == "", None).otherwise(F.col(f"`{c}`"))
    return df.select(*[(value(n).try_cast("decimal(28,6)") if kind == "number" else value(n)).alias(n) for n, kind in columns])


def save_declared_table(spark: SparkSession, path: str, columns: list[tuple[str, str]], table: str) -> None:
    """Replace a table by such a file."""
    read_declared_table(spark, path, columns).write.mode("overwrite").saveAsTable(table)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Source, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source"), F.col("value").alias("text"))


def route(path: Column) -> Column:
    """The route of a path by its extension, null if there is none; hidden files have none."""
    extension = F.lower(F.regexp_extract(path, r"(?:^|/)[^/.][^/]*\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, extensions in ROUTES.items():
        out = F.when(extension.isin(*extensions), F.lit(name)).otherwise(out)
    return out


def route_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length, route of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.withColumn("route", route(F.col("path"))).where("route is not null")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their task, place in it, bytes before them in it, and own bytes with the line feed."""
    task, place, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        start = before + np.cumsum(size) - size
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, task)), pa.array(np.arange(place, place + n)), pa.array(start), pa.array(size)], ["line", "task", "place", "start", "size"])
        place, before = place + n, before + int(size.sum())


def write_jsonl(df: DataFrame, path: str, bytes_per_file: int = 3 << 30) -> None:
    """JSON lines in files of at most so many bytes, in the order of the rows; a longer line has a file of its own.

    Tasks measure their lines; the sums before each task and line say which file a line belongs to, and one exchange by
    file writes them. Of lines of more than half a file each has its own, the others fill half a file at least.
    """
    lines = settle(df.select(F.to_json(F.struct(*df.columns)).alias("line")).mapInArrow(_measured, "line string, task long, place long, start long, size long"), "lines")
    most = max(2, bytes_per_file)
    wide = F.col("size") > most // 2
    sums = lines.groupBy("task").agg(F.max(F.col("start") + F.col("size")).alias("bytes"), F.max(F.when(~wide, F.col("size"))).alias("most")).orderBy("task").collect()  # a row a task
    room = max(1, most - max((r["most"] or 0 for r in sums), default=0) + 1)
    before, at = {}, 0
    for r in sums:
        before[r["task"]], at = at, at + r["bytes"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "task long, before long")
    small = -(-at // room)  # files of short lines
    own = lines.where(wide).select("task", "place").withColumn("file", (F.row_number().over(W.orderBy("task", "place")) - 1 + small).cast("int"))  # fewer than twice the files
    n = small + own.count()
    placed = lines.join(F.broadcast(offsets), "task").join(sized(own), ["task", "place"], "left")
    placed = placed.withColumn("file", F.coalesce("file", F.floor((F.col("before") + F.col("start")) / room).cast("int")))
    placed.repartitionById(max(1, n), "file").sortWithinPartitions("task", "place").select("line").write.mode("overwrite").text(path)


def export_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """Csv, md (a Markdown table; the head is written once a file) or txt (``column: value`` blocks)."""
    flat = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    if form == "csv":
        flat.write.mode("overwrite").csv(path, header=True)
    elif form == "md":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.col(f"`{c}`"), F.lit("|"), F.lit("\\|")) for c in flat.columns]), F.lit(" |"))
        head = f"| {' | '.join(flat.columns)} |\n|{'---|' * len(flat.columns)}"
        marked = flat.select(line.alias("value")).select(F.when(F.monotonically_increasing_id() % (1 << 33) == 0, F.concat(F.lit(head + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
        marked.write.mode("overwrite").text(path)
    elif form == "txt":
        flat.select(F.concat(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`")) for c in flat.columns]), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form {form}")


def lineage_of(lineage: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of lineage(owner_id, chunk_id, source_id, kind) of some sources(source_id), in order."""
    return lineage.join(sources.select("source_id").distinct(), "source_id", "left_semi").orderBy("source_id", "owner_id", "chunk_id")


def catalog(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Datasets of (kb, dataset) tables with row counts and how many of their documents are parsed."""
    rows = chunks.groupBy("kb", "dataset").agg(F.count("*").alias("chunks"))
    docs = status.groupBy("kb", "dataset").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "processed").alias("processed"))
    return docs.join(rows, ["kb", "dataset"], "left").select("kb", "dataset", "documents", "processed", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def full_scan(table: DataFrame, *keys: str) -> DataFrame:
    """All rows of a node or edge table, with ids as text in the first columns."""
    return table.select(*[strip(F.col(k).cast("string")).alias(k) for k in keys], *[c for c in table.columns if c not in keys])
