"""Benchmark decontamination: a broadcast hash set of item windows meets every window of the documents.

One scan, no shuffle of documents: positions are generated in the code of the scan's stage, and the hash of the
window at each, of every length that windows have, is looked up in the broadcast set of hashes. What hits is
compared word by word with the windows of that hash. Only hits, and one row a document, leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.stages import by_text, settle, sized

#: What lies between words of the rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes that are broadcast at most (about 50 bytes each); beyond, the hashes of all positions are shuffled.
MOST_HASHES = 2_000_000
MOST_WINDOWS = 100_000  # windows that hits meet by broadcast


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAPS), "")


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def windows(items: DataFrame, width: int) -> DataFrame:
    """(n, h, w, items): distinct windows of benchmark items, their hash, words and the items that hold them."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), item_words("text").alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(width))
    each = words.select("item", n.alias("n"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    out = each.select("item", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("w")).groupBy("n", "w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    h = F.lit(None).cast("long")
    for k in range(1, width + 1):
        h = F.when(F.col("n") == k, _hash(F.col("w"), F.lit(0), k)).otherwise(h)
    return out.withColumn("h", h)


def hits(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, at, n, items): a row for each place of a document where a window occurs, and one or more with null ``items`` for each document."""
    all_windows = settle(windows(items, width), "benchmark-windows")
    lengths = sorted((r["n"] for r in all_windows.select("n").distinct().collect()), reverse=True) or [width]  # at most ``width``
    known = all_windows.select("h").distinct()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), item_words(F.coalesce("text", F.lit(""))).alias("w"))
    each = words.select("doc_id", "w", F.posexplode_outer("w").alias("at", "word"))
    looks = [F.struct(F.lit(n).alias("n"), F.when(F.size("w") >= F.col("at") + n, _hash(F.col("w"), F.col("at"), n)).alias("h")) for n in lengths]
    each = each.select("doc_id", "w", "at", (looks[0] if len(looks) == 1 else F.explode(F.array(*looks))).alias("look"))
    each = each.select("doc_id", "w", "at", "look.n", "look.h")
    own = F.slice("w", F.col("at") + 1, F.col("n"))
    n_words = F.size("w").cast("long")
    if known.limit(MOST_HASHES + 1).count() <= MOST_HASHES:
        seen = each.join(F.broadcast(known.withColumn("seen", F.lit(True))), "h", "left").where(f"seen or at is null or (at = 0 and n = {lengths[0]})")
        found = seen.select("doc_id", n_words.alias("n_words"), "at", "n", "h", F.when(F.col("seen"), own).alias("w"))
    else:
        places = each.where("h is not null").select("doc_id", "at", "n", "h").join(known, "h", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n", "h")).alias("places"))
        seen = words.join(sized(places), "doc_id").select("doc_id", "w", F.explode("places").alias("p")).select("doc_id", "w", "p.*")
        found = seen.select("doc_id", n_words.alias("n_words"), "at", "n", "h", own.alias("w")).unionByName(words.select("doc_id", n_words.alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("w")))
    # words decide; rows without a hash that hit are spread by document
    found = found.withColumn("h", F.when(F.col("w").isNotNull(), F.col("h")).otherwise(F.xxhash64("doc_id")))
    same = sized(all_windows.select("h", "w", "items"), MOST_WINDOWS)
    return found.join(same, ["h", "w"], "left").select("doc_id", "n_words", F.when(F.col("items").isNotNull(), F.col("at")).alias("at"), "n", "items")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words of every distinct doc_id of docs(doc_id, text).

    A window is ``width`` consecutive words of an item(item_id, text), or all words of a shorter item; words
    inside an occurrence are hit, once each. hit_words: [start, end) word ranges that are hit, merged. A null
    or wordless text has no words; null and wordless items, and items without an id, have no windows. Rows
    that repeat a doc_id are taken as one document, whose words are those of its longest text and whose
    hits are those of all. Other columns are ignored.
    """
    by_doc = hits(docs, items, width).groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("places"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # the words that are hit, in order; a span begins where the word before is not hit
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    found = by_doc.withColumn("p", covered)
    size = F.size("p")
    before, after = F.concat(F.array(F.lit(-2)), F.slice("p", 1, F.greatest(size - 1, F.lit(0)))), F.concat(F.slice("p", 2, F.greatest(size - 1, F.lit(0))), F.array(F.lit(-2)))
    edges = lambda others, step: F.filter(F.zip_with("p", others, lambda x, y: F.when(x != y + step, x)), lambda x: x.isNotNull())
    found = found.select("*", edges(before, 1).alias("starts"), edges(after, -1).alias("ends"))
    spans = F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a, b + 1))
    return found.select(
        "doc_id", "n_words", size.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (size > 0).alias("contaminated"), F.when(size > 0, F.array_join(spans, ",")).otherwise("").alias("hit_words")
    )


def remove_documents(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs without the documents in which a window occurs; different texts of one id are documents of their own."""
    rows = by_text(docs)
    bad = settle(hits(rows, items, width).where("items is not null and doc_id is not null").select("doc_id").distinct(), "contaminated")
    return rows.join(sized(bad), "doc_id", "left_anti").select("row.*")
