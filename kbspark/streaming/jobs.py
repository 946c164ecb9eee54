"""Streams of documents and memory changes (R1-R6). Their tables are ``Deltas``: a batch reads and writes the keys that it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.text import prefixed_id, sanitize
from kbspark.jobs import settle
from kbspark.operators.aggregates import status_counts
from kbspark.operators.chunking import chunk_records, stride_chunks
from kbspark.operators.joins import build_lineage
from kbspark.operators.memory import apply_events
from kbspark.streaming.deltas import Deltas


STATUS = "doc_id string, status string, text string, batch long"


def watch(spark: SparkSession, folder: str, schema: T.StructType, per_batch: int | None = 100) -> DataFrame:
    """R2: new Parquet files of a folder, at most so many a batch (None: all that are there); the stream's checkpoint remembers those that were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def intake(stream: DataFrame, queue: Deltas, checkpoint: str):
    """documents(text) into the queue: sanitised, one a content id, pending; known ids are passed over."""

    def batch(df: DataFrame, n: int) -> None:
        clean = df.select(sanitize(F.col("text")).alias("text")).where("text <> ''")
        new = clean.select(prefixed_id("doc-", F.col("text")).alias("doc_id"), F.lit("pending").alias("status"), "text", F.lit(n).cast("long").alias("batch"))
        new = settle(new.dropDuplicates(["doc_id"]), "intake")
        known = queue.read(n, new).select("doc_id")
        queue.write(new.join(known, "doc_id", "left_anti"), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(queue: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue after done(doc_id, ok), counts): processed or failed where there is a result, processing else."""
    out = queue.join(done, "doc_id", "left").withColumn("status", F.when(F.col("ok"), "processed").when(~F.col("ok"), "failed").when(F.col("status") == "pending", "processing").otherwise(F.col("status"))).drop("ok")
    return out, status_counts(out, ("pending", "processing", "processed", "failed"))


PROGRESS = "doc_id string, status string, began timestamp, ended timestamp"


def progress_stream(results: DataFrame, state: Deltas, checkpoint: str):
    """R3 as a stream: results(doc_id, ok, began, ended) into the state of all documents; ids that it does not know are added."""

    def batch(df: DataFrame, n: int) -> None:
        last = df.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(F.when(F.col("ok"), "processed").otherwise("failed").alias("status"), "began", "ended"), "ended").alias("r"))
        state.write(last.select("doc_id", "r.*"), n)

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_k(stream: DataFrame, k: int) -> DataFrame:
    """conv_id, texts: the last k texts of each conversation(conv_id, turn, text), as state; one row a change."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, texts = state.get if state.exists else ([], [])
        rows = list(zip(turns, texts, strict=True))
        for frame in frames:
            rows = sorted([*rows, *zip(frame["turn"].tolist(), frame["text"].tolist(), strict=True)], key=lambda r: r[0])[-k:]
        state.update(([r[0] for r in rows], [r[1] for r in rows]))
        yield pd.DataFrame({"conv_id": [key[0]], "texts": [[r[1] for r in rows]]})

    return stream.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, texts array<string>", "turns array<long>, texts array<string>", "update", GroupStateTimeout.NoTimeout)


MEMORY = "memory_id long, memory string, created_at long, updated_at long"
HISTORY = "seq long, memory_id long, old_memory string, new_memory string, event string, is_deleted boolean"


def known_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """Events in their order without those of ids that are not there at their time: UPDATE and DELETE before an ADD or after a
    DELETE. ADD without text adds nothing."""
    real = events.where("event in ('ADD', 'UPDATE', 'DELETE') and (event = 'DELETE' or trim(coalesce(text, '')) <> '')")
    there = F.when(F.col("event") == "ADD", True).when(F.col("event") == "DELETE", False)
    before = F.last(there, ignorenulls=True).over(W.partitionBy("memory_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    held = real.withColumn("_b", before).join(state.select("memory_id", F.lit(True).alias("_s")), "memory_id", "left")
    return held.where("event = 'ADD' or coalesce(_b, _s, false)").select(*events.columns)


def memory_changes(stream: DataFrame, state: Deltas, history: Deltas, checkpoint: str):
    """events(seq, memory_id, event, text) into the current state and the history, which has a row an event. Of the
    state a batch reads and writes the memories that its events name."""

    def batch(df: DataFrame, n: int) -> None:
        df = settle(df.where("memory_id is not null"), "memory-events")
        old = settle(state.read(n, df), "memory-before")
        new, log, _ = apply_events(old, known_events(old, df))
        new = settle(new, "memory-after")
        history.write(log, n)
        state.write(new, n, old.join(new, "memory_id", "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHUNKS = "chunk_id string, doc_id long, chunk_order int, tokens int, text string"
LINEAGE = "owner_id string, chunk_id string, source_id string, kind string"


def refresh_chunks(stream: DataFrame, chunks: Deltas, lineage: Deltas, checkpoint: str, size: int = 128, overlap: int = 32, version: str | None = None):
    """Changed documents(doc_id, text) are cut anew; of several versions in a batch the last counts. The chunks of a
    document, and their lineage by source_id, replace the old ones; a document without words has none left."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.where("doc_id is not null")
        if version:
            df = df.groupBy("doc_id").agg(F.max_by("text", version).alias("text"))
        new = settle(chunk_records(stride_chunks(df, size, overlap)).select("chunk_id", "doc_id", "chunk_order", "tokens", "text"), "changed-chunks")
        none = df.select("doc_id").distinct().join(new, "doc_id", "left_anti")
        owned = new.select(F.col("chunk_id").alias("owner_id"), F.array("chunk_id").alias("chunk_ids"))
        rows = build_lineage(owned, new.select("chunk_id", F.col("doc_id").cast("string").alias("source_id")), "chunk").distinct()
        lineage.write(rows, n, none.select(F.col("doc_id").cast("string").alias("source_id")))
        chunks.write(new, n, none)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
