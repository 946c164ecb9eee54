"""Line dedup by content-defined windows of lines.

A window goes from one written line to the next, with the blank lines between them. Its hash rolls over every
break between written lines, so windows depend on nothing but the passage itself: any passage of two and more
written lines is a chain of windows, wherever it stands. Windows that occur again anywhere are compared byte
by byte with their first occurrence (smallest doc_id, then line) and removed where they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import text as tx
from kbspark.llm.stages import release, settle, sized, spread_join

PER_SALT = 100  # occurrences that are compared with one copy of the first
MASK = -1  # which bits of the hashes count: all

_WINDOW = "h1 long, h2 long, doc_id long, t long, first int, n int"
_BLANK = tx.SPACE.copy()
_SPACES = bytes(np.flatnonzero(_BLANK).astype(np.uint8)).decode()


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of all lines, empty ones too; every document has one line at least."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty(len(starts), np.int64)
    last = np.ones(len(starts), bool)
    last[:-1] = doc[1:] != doc[:-1]
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:][doc[last]]
    return starts, ends, doc


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tx.slices(batch):
            starts, ends, doc = _lines(data, offsets)
            h = tx.word_hashes(data, starts, ends)
            ink = np.concatenate([[0], np.cumsum(~_BLANK[data])])
            written = np.flatnonzero(ink[ends] > ink[starts])
            first = np.searchsorted(doc, np.arange(rows.num_rows))
            ids, t = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            a, b = written[:-1], written[1:]
            same = doc[a] == doc[b]
            a, b = a[same], b[same]
            h1 = tx.word_hashes(data, starts[a], ends[b])
            h2 = tx.mix(h[a] * np.uint64(0x9E3779B97F4A7C15) + h[b] * np.uint64(0xC2B2AE3D27D4EB4F) + (b - a).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([tx.longs(h1), tx.longs(h2), tx.longs(ids[doc[a]]), tx.longs(t[doc[a]]), pa.array((a - first[doc[a]]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], ["h1", "h2", "doc_id", "t", "first", "n"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed windows of each document."""
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            out = []
            for doc, t, text, listed in zip(*(batch.slice(s, 256).column(i).to_pylist() for i in range(4)), strict=True):
                lines = (text or "").split("\n")
                for c in listed:
                    if c["first"] + c["n"] <= len(lines):
                        out.append((c["h1"], c["h2"], c["salts"], c["keeper"], doc, t, c["first"], c["n"], "\n".join(lines[c["first"] : c["first"] + c["n"]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 9, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["h1", "h2", "salts", "keeper", "doc_id", "t", "first", "n", "piece"])


def _loose(lines: list[str], drop: set[int]) -> set[int]:
    """Blank lines whose neighbours with writing, or the ends of the text, are gone on both sides."""
    out, run, gone = set(), [], True
    for i, x in enumerate(lines if drop else ()):
        if i not in drop and not x.strip(_SPACES):
            run.append(i)
            continue
        if gone and i in drop:
            out.update(run)
        run, gone = [], i in drop
    return out.union(run) if gone else out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows whose last columns are text and gone, the others, n_lines, n_removed and the text that is left."""
    for batch in batches:
        others = batch.num_columns - 2
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            texts, total, gone = [], [], []
            for text, listed in zip(part.column(others).to_pylist(), part.column(others + 1).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                drop = {i for c in listed or () for i in range(c["first"], min(c["first"] + c["n"], len(lines)))}
                drop |= _loose(lines, drop)
                texts.append(text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                total.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([*part.columns[:others], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], [*part.schema.names[:others], "n_lines", "n_removed", "text"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, gone): the windows first, n (in lines) of a text that repeat an earlier one of the corpus without overlap.

    t is a hash of the text: different texts of one id are documents of their own, equal rows are one.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    found = settle(texts.mapInArrow(tx.tidy(_windows), _WINDOW).withColumns({h: F.col(h).bitwiseAND(MASK) for h in ("h1", "h2")}), "line-windows")
    again = found.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "t", "first")).alias("keep")).where("times > 1")
    again = again.withColumn("salts", F.ceil(F.col("times") / PER_SALT).cast("int"))
    apart = "doc_id <> keep.doc_id or t <> keep.t or first = keep.first or first >= keep.first + n"  # a line that repeats itself overlaps its first pair
    listed = spread_join(found, again, ["h1", "h2"], "doc_id").where(apart).select("doc_id", "t", F.struct("h1", "h2", "first", "n", "salts", (F.struct("doc_id", "t", "first") == F.col("keep")).alias("keeper")).alias("c"))
    listed = settle(listed.groupBy("doc_id", "t").agg(F.collect_set("c").alias("listed")), "line-listed")
    pieces = texts.join(sized(listed, 200_000), ["doc_id", "t"]).select("doc_id", "t", "text", "listed").mapInArrow(tx.tidy(_pieces), "h1 long, h2 long, salts int, keeper boolean, doc_id long, t long, first int, n int, piece string")
    pieces = settle(pieces, "line-pieces")
    firsts = pieces.where("keeper").select("h1", "h2", F.col("piece").alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).distinct()
    rest = pieces.where("not keeper").withColumn("salt", F.pmod(F.xxhash64("doc_id", "t", "first"), "salts").cast("int"))
    equal = rest.join(firsts, ["h1", "h2", "salt"]).where("piece = own")
    gone = settle(equal.groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "n")).alias("gone")), "line-gone")
    release(found, listed, pieces)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text of every row of docs(doc_id, text), the text without repeated passages.

    A line goes if it is part of a passage of two and more written lines that occurs, byte for byte, earlier in
    the corpus without overlapping it; so the first occurrence of every line stays. Lines end at line feeds.
    Blank lines are not written: they go within a passage, and where nothing written is left on either side of
    them. A null text stays null and has no lines; an empty one has one. Different texts of one doc_id are
    documents of their own, in the order of a hash of the text; equal rows stay or go alike. Rows without an id
    stay as they are. Other columns are ignored.
    """
    return _cleaned(docs, []).select("doc_id", "n_lines", "n_removed", "text")


def _cleaned(docs: DataFrame, others: list[str]) -> DataFrame:
    """doc_id, row (a struct of other columns, whatever their names), n_lines, n_removed, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*others, F.lit(0).alias("_")).alias("row"), "text", F.xxhash64("text").alias("t"))
    rows = rows.join(sized(repeated_windows(docs), 200_000), ["doc_id", "t"], "left").select("doc_id", "row", "text", "gone")
    return rows.mapInArrow(tx.tidy(_cut), f"doc_id long, row {dict(rows.dtypes)['row']}, n_lines long, n_removed long, text string")


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with the texts that dedup_lines leaves and n_chars to match; rows of which nothing written is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = _cleaned(docs, others).where("n_removed = 0 or length(trim(text)) > 0")
    kept = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[kept.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
