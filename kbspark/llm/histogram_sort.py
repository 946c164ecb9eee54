"""Sharding by histogram sort: shards of near equal bytes, in the order of a key, with one exchange.

Rows are ordered by a key of which the upper half is a hash of the text and the lower half one of the id, so that
equal texts are neighbours; rows of one key follow their number. Splitters are found by counting: each pass counts the
exact rows and bytes below every probe in all partitions, a probe becomes a splitter when the bytes below it meet the
tolerance, and the rest are probed again between the nearest counts. Probes lie between texts as long as such a place
meets the tolerance, so a group of equal texts is only split if it must be. Shards are split further into a bucket a
task; the counts say where each bucket begins, so the one exchange moves every row to its bucket and slots are numbered
within buckets. Only counts a probe come to the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from kbspark.llm.stages import partitions, settle

#: How far the bytes below a splitter may be from its target: of a shard's bytes, and of a bucket's within a shard.
TOLERANCE, BUCKET_TOLERANCE = 0.001, 0.1
PROBES = 15  # evenly spaced ones a pass, for a splitter of which interpolated ones did not come much nearer

# A place in the order is key * 2**64 + number of the row, as an integer without sign.
_SIGN = 1 << 63
LEVELS = (96, 64, 0)  # zero bits of places between texts, between keys, between rows
FIRST, LAST = 0, 1 << 128


def sort_key(text: Column, doc_id: Column) -> Column:
    """A long: 32 bits of the text's hash, then 32 of the id's."""
    return F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 32) - 1)))


def _arrays(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([(c >> 64) - _SIGN for c in cuts], np.int64), np.array([c & ((1 << 64) - 1) for c in cuts], np.uint64)


def place(key: np.ndarray, row: np.ndarray, cut_key: np.ndarray, cut_row: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts lie at or below each row."""
    low, high = np.searchsorted(cut_key, key, "left"), np.searchsorted(cut_key, key, "right")
    out = low.copy()
    same = np.flatnonzero(low < high)
    for first in np.unique(low[same]):  # keys of which a cut is made: the row's number decides
        at = same[low[same] == first]
        out[at] = first + np.searchsorted(cut_row[first : high[at[0]]], row[at].astype(np.uint64), "right")
    return out


def _counter(cuts: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays(cuts)
        rows, size = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            k, r, s = (c.to_numpy() for c in batch.columns)
            at = place(k, r, *arrays)
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, s)
        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(rows[seen]), pa.array(size[seen])], ["at", "n", "size"])

    return count


def histogram(rows: DataFrame, cuts: list[int]) -> list[tuple[int, int]]:
    """(rows, bytes) below each of the sorted cuts, and of all rows at the end; rows has columns key, row, size."""
    found = rows.select("key", "row", "size").mapInArrow(_counter(cuts), "at long, n long, size long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    by = {r["at"]: (r["n"], r["size"]) for r in found}
    out, n, size = [], 0, 0
    for k in range(len(cuts) + 1):
        more = by.get(k, (0, 0))
        n, size = n + more[0], size + more[1]
        out.append((n, size))
    return out


@dataclass
class Splits:
    cuts: list[int]  # where buckets after the first begin
    shard: list[int]  # of each bucket
    slot: list[int]  # of the first row of each bucket
    passes: int


def _between(low: int, high: int, share: float, bits: int) -> int | None:
    """A place with so many zero bits inside low to high, near the given share of the way."""
    first, last = (low >> bits) + 1, (high - 1) >> bits
    if first > last:
        return None
    at = first + int((last - first) * min(max(share, 0.0), 1.0))
    return min(max(at, first), last) << bits


def find_splits(rows: DataFrame, shards: int, buckets: int, tolerance: float = TOLERANCE) -> Splits:
    """Splitters of rows(key, row, size) into shards, each of ``buckets`` buckets, of near equal bytes."""
    n, total = histogram(rows, [])[0]
    parts = shards * buckets
    target = {k: total * k // parts for k in range(1, parts)}
    wide = {k: total / shards * (tolerance if k % buckets == 0 else BUCKET_TOLERANCE / buckets) for k in target}
    known, below = [FIRST, LAST], [(0, 0), (n, total)]  # probes in order, and what lies below them
    chosen: dict[int, int] = {}
    last = dict.fromkeys(target, 4 * total + 1)  # bytes between the nearest counts, a pass before
    passes = 0
    while True:
        sizes = [size for _, size in below]
        ask: set[int] = set()
        for k, t in target.items():
            if k in chosen:
                continue
            high = min(bisect_right(sizes, t), len(known) - 1)  # the first known place with more than t below it
            low = high - 1
            near = min((low, high), key=lambda x: abs(sizes[x] - t))
            between = below[high][0] - below[low][0]
            if abs(sizes[near] - t) <= wide[k] or between <= 1:
                chosen[k] = known[near]
                continue
            bits = next(b for b in LEVELS if _between(known[low], known[high], 0.5, b) is not None)
            mass = sizes[high] - sizes[low]
            guess, step = (t - sizes[low]) / mass, 3 / between**0.5
            shares = [guess - step, guess, guess + step]
            if mass > last[k] / 4:  # few texts hold most of it
                shares += [(j + 1) / (PROBES + 1) for j in range(PROBES)]
            last[k] = mass
            ask |= {p for s in shares if (p := _between(known[low], known[high], s, bits)) is not None}
        if not ask:
            break
        passes += 1
        new = sorted(ask)
        counted = dict(zip(new, histogram(rows, new), strict=False)) | dict(zip(known, below, strict=True))
        known = sorted(counted)
        below = [counted[x] for x in known]
    main = sorted(chosen[k] for k in target if k % buckets == 0)
    cuts = sorted({c for c in chosen.values() if FIRST < c < LAST})
    under = dict(zip(known, below, strict=True))
    begin = [under[c][0] for c in (FIRST, *cuts)]
    shard = [bisect_right(main, c) for c in (FIRST, *cuts)]
    first: dict[int, int] = {}
    for s, at in zip(shard, begin, strict=True):
        first.setdefault(s, at)
    return Splits(cuts, shard, [at - first[s] for s, at in zip(shard, begin, strict=True)], passes)


def _placer(splits: Splits, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, shard, slot = _arrays(splits.cuts), np.array(splits.shard, np.int32), np.array(splits.slot, np.int64)
        for batch in batches:
            k, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "row"))
            at = place(k, r, *arrays)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard[at]), pa.array(slot[at])], [*names, "bucket", "shard", "begin"])

    return run


def shard_rows(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text); with ``carry``, document too.

    size: bytes of the text and 1; law: bytes, which is that shards have near equal sums of size (within ``tolerance`` of
    a shard, or one row where rows are larger), in the order of ``sort_key``; slot: gapless from 0 in a shard;
    grown_shard: null under this law. A null text counts as empty. Repeated rows and null ids are rows like others. Fewer
    rows than shards leave shards without rows. document: all columns of docs as one struct, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    columns = [doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), sort_key(text, doc_id).alias("key")]
    whole = [F.struct(*docs.columns).alias("document")] if carry else []
    kept = settle(docs.select(*columns, F.monotonically_increasing_id().alias("row"), *whole), "shard-rows")
    splits = find_splits(kept, shards, max(1, -(-partitions(spark) // shards)), tolerance)
    placed = kept.mapInArrow(_placer(splits, kept.columns), StructType([*kept.schema, *(StructField(c, t) for c, t in (("bucket", IntegerType()), ("shard", IntegerType()), ("begin", LongType())))]))
    order = Window.partitionBy("bucket").orderBy("key", "row")
    numbered = placed.repartitionById(len(splits.shard), "bucket").withColumn("slot", F.col("begin") + F.row_number().over(order) - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(["document"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write docs as Parquet in folders shard=0, shard=1, ...: slot and document, by slot within each file."""
    shard_rows(docs, shards, carry=True).select("shard", "slot", "document").write.partitionBy("shard").parquet(path)
