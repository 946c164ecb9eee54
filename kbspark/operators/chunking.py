"""Text preparation: pages, chunks, tables, HTML, corpus dedup."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions.text import content_id, sanitize, strip
from kbspark.jobs import small_batches

# After any of these a window may be cut.
STOPS = "。.,，!?！？\n"


def explode_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text) of docs(doc_id, pages map<string, array<struct<type, text, caption, desc>>>).

    The last element gives a page's text; an image gives ``caption: desc``; line feeds become commas."""
    each = docs.select("doc_id", F.explode("pages").alias("name", "elements"))
    last = F.element_at("elements", -1)
    text = F.when(last["type"] == "image", F.concat_ws(": ", last["caption"], last["desc"])).otherwise(last["text"])
    return each.where(F.size("elements") > 0).select("doc_id", F.regexp_extract("name", r"page_(\d+)", 1).cast("int").alias("page"), F.translate(text, "\n", ",").alias("text"))


def words(c: Column) -> Column:
    """Default tokens: what lies between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def stride_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128, split: str | None = None, split_only: bool = False) -> DataFrame:
    """doc_id, chunk_order, tokens, text: windows of ``size`` tokens, ``size - overlap`` apart, of docs(doc_id, text).

    With ``split`` the text is cut there first; with ``split_only`` the parts are the chunks."""
    parts = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", re.escape(split)) if split else F.array("text")).alias("part", "piece"))
    parts = parts.select("doc_id", "part", "piece", words(F.col("piece")).alias("w")).where("size(w) > 0")
    if split_only:
        each = parts.select("doc_id", "part", F.lit(0).alias("at"), F.size("w").alias("tokens"), strip(F.col("piece")).alias("text"))
    else:
        starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))
        window = lambda at: F.struct(at.alias("at"), F.least(F.size("w") - at, F.lit(size)).alias("tokens"), F.array_join(F.slice("w", at + 1, F.lit(size)), " ").alias("text"))
        each = parts.select("doc_id", "part", F.explode(F.transform(starts, window)).alias("x")).select("doc_id", "part", "x.*")
    if split is None:
        return each.select("doc_id", (F.col("at") / (size - overlap)).cast("int").alias("chunk_order"), "tokens", "text")
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "at")) - 1
    return each.select("doc_id", order.alias("chunk_order"), "tokens", "text")


def _window_cuts(text: str, size: int, overlap: int, encode: Callable, decode: Callable, stops: str) -> Iterator[tuple[int, int, str]]:
    tokens = encode(text)
    at = 0
    while at < len(tokens):
        end = min(at + size, len(tokens))
        piece = decode(tokens[at:end])
        if end < len(tokens):
            stop = max((piece.rfind(c) for c in stops), default=-1)
            if stop > 0:
                piece = piece[: stop + 1]
                end = at + max(1, len(encode(piece)))
        if piece.strip():
            yield at, end, piece.strip()
        if end >= len(tokens) or end - overlap <= at:
            break
        at = end - overlap


def sentence_chunks(docs: DataFrame, size: int = 1024, overlap: int = 50, encode: Callable | None = None, decode: Callable | None = None, stops: str = STOPS) -> DataFrame:
    """doc_id, chunk_order, start, end, text: token windows cut after the last of the stops inside, the next one ``overlap``
    tokens before the end; ends where it would not advance. encode and decode are a tokenizer (U3); by default
    tokens are runs of non-blanks with the blanks before them."""
    enc = encode or (lambda t: re.findall(r"\s*\S+|\s+$", t))
    dec = decode or "".join

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, s, e, t) for d, text in zip(frame["doc_id"], frame["text"], strict=True) if text for i, (s, e, t) in enumerate(_window_cuts(text, size, overlap, enc, dec, stops))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_order", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_order int, start int, end int, text string")


def custom_chunks(docs: DataFrame, chunker: Callable[[str], list[str]]) -> DataFrame:
    """doc_id, chunk_order, text: what a chunker of the user's makes of each text of docs(doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, piece) for d, text in zip(frame["doc_id"], frame["text"], strict=True) if text for i, piece in enumerate(chunker(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_order", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_order int, text string")


# Punctuation from strongest to weakest.
_PUNCTUATION = [".", "?", "!", "*", ";", ",", "(", ")", "[", "]", "“", "”", "‘", "’", "'", '"', "`", ":", "—", "…", "/", "\\", "–", "&", "-"]


def _splitter(text: str) -> str:
    for pattern in (r"[\r\n]+", r"\t+", r"\s+"):
        runs = re.findall(pattern, text)
        if runs:
            longest = max(runs, key=len)
            if pattern == r"\s+" and len(longest) == 1:
                for mark in _PUNCTUATION:
                    found = re.search(re.escape(mark) + r"(\s)", text)
                    if found:
                        return f"(?<={re.escape(mark)})" + re.escape(found[1])
            return re.escape(longest)
    for mark in _PUNCTUATION:
        if mark in text:
            return f"(?<={re.escape(mark)})"
    return ""


def _semantic(text: str, size: int, count: Callable[[str], int]) -> list[str]:
    if count(text) <= size or len(text) <= 1:
        return [text]
    pattern = _splitter(text)
    if not pattern:
        half = len(text) // 2
        return _semantic(text[:half], size, count) + _semantic(text[half:], size, count)
    cuts = [0, *(m.end() for m in re.finditer(pattern, text)), len(text)]
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    if len(pieces) == 1:
        half = len(text) // 2
        pieces = [text[:half], text[half:]]
    out: list[str] = []
    for piece in pieces:
        if out and count(out[-1] + piece) <= size:
            out[-1] += piece
        else:
            out += _semantic(piece, size, count)
    return out


HELD = 1 << 20  # characters of texts whose chunks are handed on at once


def semantic_chunks(docs: DataFrame, size: int, count: Callable[[str], int] | None = None) -> DataFrame:
    """C4: doc_id, chunk_order, start, end, text: recursive cuts at the longest run of line feeds, tabs or blanks, then
    after punctuation; neighbours are put together up to ``size``; offsets are those of the text."""
    counter = count or (lambda t: len(t.split()))
    names = ["doc_id", "chunk_order", "start", "end", "text"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):  # a text at once
                d, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                at = order = 0
                for piece in _semantic(text, size, counter) if text else []:
                    if piece.strip():
                        rows.append((d, order, at, at + len(piece), piece.strip()))
                        order += 1
                    at += len(piece)
                held += len(text)
                if rows and (held >= HELD or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_order int, start int, end int, text string")


def table_chunks(rows: DataFrame, table: str, order: str, columns: list[str], per: int = 50, caption: str = "") -> DataFrame:
    """(table, chunk, text): Markdown of ``per`` data rows with the head repeated; the first has the caption, others
    say (continued)."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(table).orderBy(order))).withColumn("chunk", F.floor((F.col("_n") - 1) / per).cast("int"))
    body = numbered.groupBy(table, "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |\n"
    title = F.when(F.col("chunk") == 0, F.lit(f"{caption}\n" if caption else "")).otherwise(F.lit(f"{caption} (continued)\n" if caption else "(continued)\n"))
    return body.select(table, "chunk", F.concat(title, F.lit(head), "body").alias("text"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id = SHA-256 of the text; blank ones go."""
    return chunks.where(F.length(strip(F.col("text"))) > 0).withColumn("chunk_id", content_id(F.col("text")))


BLOCK = 1024  # chunks of a source whose places are summed at once


def rechunk(chunks: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """source_id, new_order, text, chunk_ids: the chunks(source_id, chunk_id, chunk_order, text) of a source put
    together in order and cut anew; chunk_ids are those whose token range overlaps the new one's. Each chunk is cut
    where the new ones begin, so that no row holds a whole source; chunks without tokens go."""
    rows = chunks.select("source_id", "chunk_id", "chunk_order", words(F.col("text")).alias("w")).where("size(w) > 0")
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("part", F.floor(F.col("chunk_order") / BLOCK))
    before = F.sum("n").over(W.partitionBy("source_id").orderBy("part")) - F.col("n")
    parts = rows.groupBy("source_id", "part").agg(F.sum("n").alias("n")).select("source_id", "part", before.alias("base"))
    end = F.col("base") + F.sum("n").over(W.partitionBy("source_id", "part").orderBy("chunk_order"))
    old = rows.join(parts, ["source_id", "part"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    step = size - overlap
    new = F.explode(F.sequence(F.greatest(F.floor((F.col("start") - size) / step) + 1, F.lit(0)), F.floor((F.col("end") - 1) / step)))
    cut = old.withColumn("new_order", new).withColumn("low", F.greatest("start", F.col("new_order") * step)).withColumn("high", F.least("end", F.col("new_order") * step + size))
    pieces = cut.select("source_id", F.col("new_order").cast("int").alias("new_order"), F.struct("chunk_order", "chunk_id", F.array_join(F.slice("w", (F.col("low") - F.col("start") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")), " ").alias("t")).alias("p"))
    whole = pieces.groupBy("source_id", "new_order").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("source_id", "new_order", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"), F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"))


# Elements whose text is left out.
_DROPPED = {"script", "style", "footer", "nav", "aside", "iframe", "button", "noscript"}
# Image attributes by priority.
_IMAGE = ("data-src", "data-original", "data-lazy-src", "data-url", "src", "srcset")
# Elements without an end.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.meta, self.og = url, "", "", ""
        self.open: list[str] = []
        self.elements: list[tuple[str, str, str]] = []
        self.seen: set[str] = set()
        self.table: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self.open.append(tag)
        if tag == "meta":
            if a.get("name", "").lower() == "description":
                self.meta = a.get("content", "").strip()
            elif a.get("property", "").lower() == "og:description":
                self.og = a.get("content", "").strip()
        if self.hidden():
            return
        if tag == "img":
            link = next((a[k].split(",")[0].split()[0] for k in _IMAGE if a.get(k, "").strip()), "")
            link = urljoin(self.url, link) if link else ""
            if link and not link.lower().split("?")[0].endswith(".svg") and not link.startswith("data:") and link not in self.seen:
                self.seen.add(link)
                self.elements.append(("image", a.get("alt", "").strip(), link))
        elif tag == "table" and self.table is None:
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.table[-1].append("")

    def hidden(self) -> bool:
        return any(t in _DROPPED for t in self.open)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag == "table" and self.table is not None and "table" not in self.open:
            text = "\n".join(" | ".join(c.strip() for c in r) for r in self.table if r)
            self.table = None
            if text:
                self.elements.append(("table", text, ""))

    def handle_data(self, data):
        if "title" in self.open and "head" in self.open or self.open[-1:] == ["title"]:
            self.title += data
        elif not self.hidden():
            text = re.sub(r"\s+", " ", data).strip()
            if self.table is not None:
                if self.table and self.table[-1]:
                    self.table[-1][-1] += " " + text
            elif text:
                self.elements.append(("text", text, ""))


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, description, merged, elements of pages(page_id, url, html). elements: type, number within
    its type, text, url, in the order of the page; merged: the texts with white space collapsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, url, html in frame[["page_id", "url", "html"]].itertuples(index=False):
                p = _Page(url or "")
                p.feed(html or "")
                p.close()
                count: dict[str, int] = {}
                elements = []
                for kind, text, link in p.elements:
                    count[kind] = count.get(kind, 0) + 1
                    elements.append({"type": kind, "number": count[kind], "text": text, "url": link})
                merged = " ".join(t for k, t, _ in p.elements if k in ("text", "table"))
                rows.append((i, re.sub(r"\s+", " ", p.title).strip(), p.meta or p.og, re.sub(r"\s+", " ", merged).strip(), elements))
            yield pd.DataFrame(rows, columns=["page_id", "title", "description", "merged", "elements"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, description string, merged string, elements array<struct<type:string,number:int,text:string,url:string>>")


def page_layout(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, elements, merged) of blocks(doc_id, page, position, type, text): each element numbered within its
    type, texts merged in order."""
    numbered = blocks.withColumn("number", F.row_number().over(W.partitionBy("doc_id", "page", "type").orderBy("position")))
    ordered = F.sort_array(F.collect_list(F.struct("position", "type", "number", "text")))
    return numbered.groupBy("doc_id", "page").agg(ordered.alias("e")).select(
        "doc_id", "page", F.transform("e", lambda x: F.concat_ws("_", x["type"], x["number"])).alias("elements"), F.array_join(F.filter(F.transform("e", lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n").alias("merged")
    )


def first_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The first row (by key) of each sanitised text, which it has from then on; null and empty ones go. Texts are
    compared by their SHA-256; counting is pre-summed by task. A key that repeats is an error of the caller's: all
    its rows stay if one is a first."""
    clean = docs.withColumn(text, sanitize(F.col(text))).where(F.col(text) != "")
    first = clean.groupBy(content_id(F.col(text)).alias("_h")).agg(F.min(key).alias(key)).select(key)
    return clean.join(first, key, "left_semi")
