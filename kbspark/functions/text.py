"""Scalar expressions over text: sanitation, names, ids, numbers, previews, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"

# HTML entities that sanitation of variant B replaces.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

# Factors of number words and units; those of Latin letters in either case.
UNITS = {"千": 1e3, "万": 1e4, "十万": 1e5, "百万": 1e6, "千万": 1e7, "亿": 1e8, "十亿": 1e9, "百亿": 1e10, "千亿": 1e11, "万亿": 1e12, "k": 1e3, "thousand": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}

# Words for symbols in relation labels.
SYMBOLS = {
    "...": "_ellipsis_", "…": "_ellipsis_", "。": "_period_", "，": "_comma_", "；": "_semicolon_", "：": "_colon_", "！": "_exclamation_", "？": "_question_", "（": "_lparen_", "）": "_rparen_", "【": "_lbracket_", "】": "_rbracket_", "《": "_langle_", "》": "_rangle_",
    "'": "_apostrophe_", '"': "_quote_", "\\": "_backslash_", "/": "_slash_", "|": "_pipe_", "&": "_ampersand_", "=": "_equals_", "+": "_plus_", "*": "_asterisk_", "^": "_caret_", "%": "_percent_", "$": "_dollar_", "#": "_hash_", "@": "_at_", "!": "_bang_", "?": "_question_",
    "(": "_lparen_", ")": "_rparen_", "[": "_lbracket_", "]": "_rbracket_", "{": "_lbrace_", "}": "_rbrace_", "<": "_langle_", ">": "_rangle_",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sanitize(c: Column) -> Column:
    """P1 A: strip; drop controls but tab, line feed and carriage return, and non-characters."""
    return strip(F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFE\\uFFFF]", ""))


def sanitize_html(c: Column) -> Column:
    """P1 B: replace HTML entities; drop all C0 and C1 controls; strip."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(c, "[\\x00-\\x1F\\x7F-\\x9F]", ""))


def sanitize_prefix(c: Column, n: int) -> Column:
    """P1 C: drop NUL; keep n characters; strip."""
    return strip(F.left(F.regexp_replace(c, "\\x00", ""), F.lit(n)))


def name_key(c: Column) -> Column:
    """P2 (2): strip and lower-case."""
    return F.lower(strip(c))


def name_identifier(c: Column) -> Column:
    """P2 (4): lower-case, blanks to underscores."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def name_spaced(c: Column) -> Column:
    """P2 (3): full-width brackets and dashes to plain ones, no blanks between CJK characters, outer quotes off."""
    c = F.translate(c, "（）—－", "()--")
    c = F.regexp_replace(c, f"(?<=[{CJK}])\\s+(?=[{CJK}])", "")
    c = F.regexp_replace(c, f"(?<=[{CJK}])\\s+(?=[a-zA-Z0-9()\\[\\]@#$%!&*\\-=+_])", "")
    c = F.regexp_replace(c, f"(?<=[a-zA-Z0-9()\\[\\]@#$%!&*\\-=+_])\\s+(?=[{CJK}])", "")
    return strip(F.regexp_replace(strip(c), "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))


def relation_label(c: Column) -> Column:
    """P2 (5): symbols to words, runs of underscores to one, none at the ends; case and blanks stay."""
    for symbol, word in SYMBOLS.items():
        c = F.replace(c, F.lit(symbol), F.lit(word))
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")


def content_id(c: Column) -> Column:
    """64 hexadecimal digits of SHA-256."""
    return F.sha2(c, 256)


def short_id(c: Column) -> Column:
    """The first 32 of them."""
    return F.left(F.sha2(c, 256), F.lit(32))


def prefixed_id(prefix: str, c: Column) -> Column:
    """``doc-``, ``chunk-``, ``ent-`` or ``rel-`` and the MD5."""
    return F.concat(F.lit(prefix), F.md5(c))


def parse_number(c: Column) -> Column:
    """The value of a number, with thousands separators and at most one unit; null if the text is none."""
    text = F.replace(strip(c), F.lit(","), F.lit(""))
    plain = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    parts = rf"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))$"
    unit = F.lower(F.regexp_extract(text, parts, 2))
    factor = F.lit(None).cast("double")
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.coalesce(plain, F.regexp_extract(text, parts, 1).try_cast("double") * factor)


def number_or_text(c: Column) -> Column:
    """Struct num, text: the value of a number, or the stripped text where it is none."""
    num = parse_number(c)
    return F.struct(num.alias("num"), F.when(num.isNull(), strip(c)).alias("text"))


def magnitude(c: Column) -> Column:
    """P5: two decimals of the number as it is stored, and T, B or M from 1e12, 1e9 and 1e6 on."""
    shown = lambda x, name: F.concat(F.call_function("format_number", x, F.lit("0.00")), F.lit(name))
    out = shown(c, "")
    for low, name in ((1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(c >= low, shown(c / low, name)).otherwise(out)
    return out


def token_estimate(c: Column) -> Column:
    """A token for 1.5 CJK characters and one for 4 others."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.floor(cjk / 1.5 + (F.length(c) - cjk) / 4).cast("long")


def preview(c: Column, n: int = 250, tail: str = "...") -> Column:
    """P7."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(tail))).otherwise(c)


def split_markers(c: Column, *markers: str) -> Column:
    """P10: parts between any of the markers, stripped, without empty ones."""
    import re

    return F.filter(F.transform(F.split(c, "|".join(re.escape(m).replace("\\ ", " ") for m in markers)), strip), lambda x: x != "")


def id_list(c: Column) -> Column:
    """Ids of a plain, comma-joined, JSON or Python-literal list, distinct, in order."""
    bare = F.regexp_replace(c, r"[\[\]'\"()]", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, r",|<SEP>"), strip), lambda x: x != ""))


def pair_key(c: Column) -> Column:
    """(a, b) of "a||b", a JSON array or a tuple literal; null if it is neither."""
    bars = F.split(c, r"\|\|")
    listed = F.transform(F.split(F.regexp_replace(c, r"[\[\]'\"()]", ""), ","), strip)
    out = F.when(F.contains(c, F.lit("||")) & (F.size(bars) == 2), F.transform(bars, strip)).when(c.rlike(r"^\s*[\[(].*[\])]\s*$") & (F.size(listed) == 2), listed)
    return out


def identifier(c: Column) -> Column:
    """Letters, digits and underscores only, not beginning with a digit; nothing becomes ``_``."""
    out = F.regexp_replace(strip(c), r"[^0-9A-Za-z_一-鿿]", "_")
    return F.when(out == "", F.lit("_")).when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)


def missing_keywords(text: Column, keywords: Column) -> Column:
    """Keywords that the text does not contain, case-insensitively."""
    return F.filter(keywords, lambda k: ~F.contains(F.lower(text), F.lower(k)))


def joined_paths(paths: Column, limit: int = 32768 - 5, mark: str = "<SEP>") -> Column:
    """Distinct paths in first-seen order, until one more would exceed the limit of UTF-8 bytes."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(a: Column, p: Column) -> Column:
        longer = F.when(a["s"] == "", p).otherwise(F.concat(a["s"], F.lit(mark), p))
        over = a["full"] | (F.octet_length(longer) > limit)
        return F.struct(F.when(over, a["s"]).otherwise(longer).alias("s"), over.alias("full"))

    return F.aggregate(F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != ""))), start, add, lambda a: a["s"])


def display_time(seconds: Column) -> Column:
    """Epoch seconds as yyyy-MM-dd HH:mm:ss (session time zone)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def iso_display_time(c: Column) -> Column:
    """An ISO date and time, with or without an offset, as yyyy-MM-dd HH:mm:ss (session time zone); null if it is none."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm:ss")


def epoch_of_display(c: Column) -> Column:
    """Yyyy-MM-dd HH:mm:ss (session time zone) as epoch seconds; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


def index_tokens(c: Column) -> Column:
    """C11: lower-cased tokens of a keyword index: between white space; runs of CJK characters as bigrams."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"[{CJK}]+|[^\\s{CJK}]+"), F.lit(0))
    grams = lambda r: F.when((F.length(r) > 1) & r.rlike(f"^[{CJK}]"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))).otherwise(F.array(r))
    return F.flatten(F.transform(runs, grams))


def render_numbered(rank: Column, text: Column) -> Column:
    """P20: ``[n] text``."""
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), text)


def composed(query: Column, video: Column, audio: Column, image: Column) -> Column:
    """Labelled lines of the captions that are not empty."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Query", query), line("Video", video), line("Audio", audio), line("Image", image))
