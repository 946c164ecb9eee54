"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its hits, embedded checksums.

One automaton holds the assignment keywords, the access-key prefix, the prefixes of tokens with a
checksum inside and, for hexadecimal runs, every four-digit hexadecimal string: a run of 32 and more
cannot avoid them. Only at hits is an expression tried, anchored there; a text without hits costs one
pass of the automaton.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords and kinds of the base rule.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = "AKIA"
KINDS = ("assign", "access", "hex", "checked")
# Public prefixes of tokens that end in a base-62 CRC-32 of their other characters.
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_CHECKED = re.compile("(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NOT_HEX = re.compile("[^0-9a-f]")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for four in itertools.product("0123456789abcdef", repeat=4):
        a.add_word("".join(four), ("hex", 4))
    for word in KEYWORDS:
        a.add_word(word, ("assign", len(word)))
    a.add_word(ACCESS.lower(), ("access", 4))
    for word in CHECKED:
        a.add_word(word, ("checked", len(word)))
    a.make_automaton()
    return a


def crc_matches(body: str, tail: str) -> bool:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out == tail


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of a text, in code points, sorted."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # lower-cases A-Z only
    after = dict.fromkeys(KINDS, 0)
    out = []
    for end, (kind, size) in _automaton().iter(low):
        start = end + 1 - size
        if start < after[kind]:
            continue
        if kind == "hex":
            if not (m := _HEX.match(text, start)):
                continue
            # earlier digits would have hit: the run starts here unless letters of the other case broke it
            after[kind] = m.end()
            while start and text[start - 1] in "0123456789abcdef":
                start -= 1
            if m.end() - start >= 32:
                out.append((start, 2, m.end()))
        elif kind == "assign":
            if m := _ASSIGN.match(text, start):
                after[kind] = m.end()
                if m.end() - m.start(1) >= 8:
                    out.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                after[kind] = m.end()
                if m.end() - start >= 16:
                    out.append((start, 1, m.end()))
        elif (m := _CHECKED.match(text, start)) and crc_matches(m[1], m[2]) and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            after[kind] = m.end()
            out.append((start, 3, m.end()))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            rows = []
            for text in part.column(1):
                found = find(text.as_py() or "")
                write = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                base = ",".join(w for w, f in zip(write, found, strict=True) if f[1] < 3)
                n = [sum(f[1] == k for f in found) for k in range(4)]
                rows.append((*n, sha256(base.encode()).hexdigest(), ",".join(write)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5])], ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Of every row of docs(doc_id, text): counts a kind, base_sha256, spans.

    Kinds assign, access and hex follow the base rule (leftmost, non-overlapping a kind, failing matches
    dropped); ``checked`` adds tokens whose embedded CRC-32 is right. A null text is empty: no span, and
    the hash of nothing. Overlaps between kinds stay. Repeated rows give a row each.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with its secrets replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, _, end in find(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
