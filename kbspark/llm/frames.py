"""Fill-in-middle over seekable compressed frames.

A text is kept as independent zstandard frames of about FRAME bytes, each with the bytes, code points and units that
come before it. A unit is the n-th token of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, so units start
where a text starts and where white space follows something else, and a frame can count its starts alone. To
cut after k units only the frame in which unit k starts is decompressed; outputs, their digests and the texts that are
rebuilt from outputs are streamed frame by frame in order.

The store is a table of the shared folder; the cuts are column expressions over its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.stages import settle
from kbspark.llm.text import SPACE, tidy

FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: What an output has, in order: a mark and the part of the text that follows it.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

_ENTRY = pa.struct([("bytes", pa.int64()), ("chars", pa.int64()), ("units", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())])
FRAMES = "array<struct<bytes: bigint, chars: bigint, units: bigint, inside: boolean, data: binary>>"


def _starts(piece: np.ndarray, inside: bool, first: bool) -> np.ndarray:
    """Which bytes start a unit; inside: the byte before is not white space."""
    space = SPACE[piece]
    out = space.copy()
    out[1:] &= ~space[:-1]
    out[0] = first or (space[0] and inside)
    return out


def _chars(piece: bytes | np.ndarray) -> int:
    return int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80))


def compressed(pieces: Iterator[bytes], zip_: zstandard.ZstdCompressor, frame: int = FRAME) -> tuple[list[dict], int, int]:
    """Frames of a text that comes in pieces, its units and its bytes. Only one frame is held uncompressed."""
    out, held, n, chars, units, inside = [], bytearray(), 0, 0, 0, False

    def close(size: int) -> None:
        nonlocal n, chars, units, inside
        data = bytes(held[:size])
        del held[:size]
        piece = np.frombuffer(data, np.uint8)
        out.append({"bytes": n, "chars": chars, "units": units, "inside": inside, "data": zip_.compress(data)})
        units += int(np.count_nonzero(_starts(piece, inside, n == 0)))
        chars += _chars(data)
        n += size
        inside = not SPACE[piece[-1]]

    for piece in pieces:
        for at in range(0, len(piece), frame):
            held += piece[at : at + frame]
            while len(held) > frame:
                size = frame
                while size > frame - 3 and held[size] & 0xC0 == 0x80:  # not inside a code point
                    size -= 1
                close(size)
    if held:
        close(len(held))
    return out, units, n


class Frames:
    """Reads the frames of a text; the frame that was read last stays decompressed."""

    def __init__(self, frames: list[dict], size: int, unzip: zstandard.ZstdDecompressor):
        self.frames, self.size, self._unzip, self._last = frames, size, unzip, (-1, b"")
        self.opened = 0

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.opened += 1
            self._last = k, self._unzip.decompress(self.frames[k]["data"], max_output_size=self.size)
        return self._last[1]

    def _holds(self, key: str, value: int) -> int:
        low, high = 0, len(self.frames)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.frames[mid][key] <= value else (low, mid)
        return low

    def seek(self, unit: int, units: int) -> tuple[int, int]:
        """(byte, code point) where a unit starts; the end of the text for the number of its units."""
        if not self.frames or unit <= 0:
            return 0, 0
        if unit >= units:
            k = len(self.frames) - 1
            return self.size, self.frames[k]["chars"] + _chars(self.frame(k))
        k = self._holds("units", unit)
        f = self.frames[k]
        data = self.frame(k)
        at = np.flatnonzero(_starts(np.frombuffer(data, np.uint8), f["inside"], k == 0))
        if unit - f["units"] >= len(at):  # units of this frame all start before: it is the first byte of a later one
            raise ValueError("frame counts do not fit")
        at = int(at[unit - f["units"]])
        return f["bytes"] + at, f["chars"] + _chars(data[:at])

    def read(self, start: int, end: int) -> Iterator[bytes]:
        if end <= start:
            return
        for k in range(self._holds("bytes", start), len(self.frames)):
            f = self.frames[k]
            if f["bytes"] >= end:
                return
            data = self.frame(k)
            yield data[max(0, start - f["bytes"]) : end - f["bytes"]]

    def find(self, mark: bytes, start: int) -> int:
        """Where a mark of three bytes begins, at ``start`` or after; it may lie across frames."""
        tail, at = b"", start
        for piece in self.read(start, self.size):
            both = tail + piece
            found = both.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = both[1 - len(mark) :]
        raise ValueError("mark not found")


def arranged(text: Frames, form: str, low: int, high: int) -> Iterator[bytes]:
    """An output in pieces: the text itself, or its three parts, cut at bytes low and high, behind their marks."""
    if form == "plain":
        yield from text.read(0, text.size)
        return
    parts = ((0, low), (low, high), (high, text.size))
    for mark, part in ORDERS[form]:
        yield mark
        yield from text.read(*parts[part])


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text in pieces, from an output and its form alone: the parts between marks, in the order of the text."""
    if form == "plain":
        yield from output.read(0, output.size)
        return
    places = [0]
    for mark, _ in ORDERS[form][1:]:
        places.append(output.find(mark, places[-1] + 3))
    ends = [*places[1:], output.size]
    spans = {part: (a + 3, b) for (_, part), a, b in zip(ORDERS[form], places, ends, strict=True)}
    for part in range(3):
        yield from output.read(*spans[part])


def _digest(pieces: Iterator[bytes]) -> str:
    h = sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    for k in range(batch.num_rows):
        yield [c[k] for c in batch.columns]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            ids, out = part.column(0), []
            for text in part.column(1):
                view = memoryview(text.as_buffer()) if text.is_valid else b""
                marked, at = False, 0
                while at < len(view) and not marked:  # pieces overlap by two bytes
                    piece = bytes(view[at : at + FRAME + 2])
                    marked = any(m in piece for m in (PREFIX, SUFFIX, MIDDLE))
                    at += FRAME
                out.append((*compressed((bytes(view[a : a + FRAME]) for a in range(0, len(view), FRAME)), zip_), marked))
            frames, units, sizes, marks = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(units, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.bool_()), pa.array(frames, pa.list_(_ENTRY))], ["doc_id", "n", "size", "marked", "frames"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), size (bytes), marked, frames of every row of docs(doc_id, text), as a table of the shared folder.

    A null text is empty: no frames, no units. marked: the text holds one of the three marks. Repeated rows give a
    row each, null ids stay, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return settle(rows.mapInArrow(tidy(_store), f"doc_id long, n long, size long, marked boolean, frames {FRAMES}"), "frames")


def draws(seed: int, doc_id: Column, n: Column, marked: Column, rate: int, spm: int) -> list[Column]:
    """form, low, high: what is done to a document and the units after which prefix and middle end."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when((n == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return [form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def _transform(batches: Iterator[pa.RecordBatch], with_frames: bool) -> Iterator[pa.RecordBatch]:
    zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part, out = batch.slice(s, 256), []
            for n, size, form, low, high, frames in _rows(part.drop_columns(["doc_id"])):
                form = form.as_py()
                text = Frames(frames.as_py() or [], size.as_py(), unzip)
                if form == "plain":
                    digest = _digest(text.read(0, text.size))
                    out.append((None, None, digest, digest, text.size, frames if with_frames else None))
                    continue
                (a, chars), (b, more) = text.seek(low.as_py(), n.as_py()), text.seek(high.as_py(), n.as_py())
                h = sha256()

                def pieces(text=text, form=form, a=a, b=b, h=h) -> Iterator[bytes]:
                    for p in arranged(text, form, a, b):
                        h.update(p)
                        yield p

                made, _, size = compressed(pieces(), zip_)
                out.append((chars, more - chars, h.hexdigest(), _digest(restored(Frames(made, size, unzip), form)), size, made if with_frames else None))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            arrays = [part.column(0), part.column(1), part.column(3), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "size"]
            if with_frames:
                arrays.append(pa.array([f.as_py() if isinstance(f, pa.Scalar) else f for f in cols[5]], pa.list_(_ENTRY)))
                names.append("frames")
            yield pa.RecordBatch.from_arrays(arrays, names)


def fill_in_middle(kept: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, with_frames: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, size, frames of every row of a ``store``.

    rate: of a hundred texts, those that are cut; spm: of a hundred of these, those with the suffix first. Both and the
    cuts are drawn from sha256 of the seed and the id, so that every run gives the same; a null id is drawn as
    none written. Texts that are empty or hold a mark stay plain, whose code points are null. restored_sha256 is of
    the text rebuilt from the output's own frames, size the bytes of the output and frames (with_frames) the output.
    """
    cut = kept.select("doc_id", "n", "size", *draws(seed, F.col("doc_id"), F.col("n"), F.col("marked"), rate, spm), "frames")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, size long" + f", frames {FRAMES}" * with_frames
    return cut.mapInArrow(tidy(lambda batches: _transform(batches, with_frames)), schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            own = Frames(row.column(2)[0].as_py() or [], row.column(1)[0].as_py(), unzip)
            text = pa.array([b"".join(own.read(0, own.size))], pa.binary())
            yield pa.RecordBatch.from_arrays([row.column(0), text], ["doc_id", "text"])


def texts(frames: DataFrame) -> DataFrame:
    """doc_id, text of rows with doc_id, size, frames: of a store the texts, of ``fill_in_middle`` the outputs."""
    return frames.select("doc_id", "size", "frames").mapInArrow(tidy(_texts), "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc_id, n, size, low, high, frames in _rows(batch):
            own, units = Frames(frames.as_py() or [], size.as_py(), unzip), n.as_py()
            a, b = (own.seek(x.as_py(), units)[0] for x in (low, high))
            yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([b"".join(own.read(a, b))], pa.binary())], ["doc_id", "text"])


def units(kept: DataFrame, low: Column, high: Column) -> DataFrame:
    """doc_id, text: the units low to high (excluded) of every text of a store; frames outside are not decompressed."""
    rows = kept.select("doc_id", "n", "size", F.greatest(F.lit(0), low).cast("long").alias("low"), F.least(F.col("n"), high).cast("long").alias("high"), "frames")
    return rows.mapInArrow(tidy(_units), "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
