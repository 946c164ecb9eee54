"""N-gram Jaccard join: documents whose word-shingle sets are alike, and the classes they form.

Sizes are cut into bands whose ratio is the similarity, so that linked sets lie in one band or in
neighbours; such a pair of bands is a tile. Two sets of a tile that link differ in at most d shingles,
so with more than d parts of the hash space they agree in a whole part. Equal sets are one class, for which
its smallest id stands. Each class therefore shows one hash a part of each of its tiles, and classes that show
the same hash are candidates:

1. in each bucket of equal hashes every set is paired with the smallest id (a star, never all pairs);
   parity bitmaps bound the overlap from above, and what passes and met in enough buckets is compared exactly
   by sorted arrays;
2. buckets that still hold more than one component are compared bitmap by bitmap, in blocks of at most
   BLOCK sets over as many tasks as there are pairs of blocks. Only pairs of different components whose
   bound passes are kept and, if they met in enough buckets, compared exactly.

Enough: as sets that link have more than the spare parts in common, they meet in as many buckets of the tile of the smaller
one, but for parts that one of them does not show. Bitmaps tell little about large sets, of which any two
that share a passage would else be compared by their texts.

Candidates are found by word hashes of one family and compared by those of another, so words that collide
in the first do not link.

A link inside a component cannot change it, so no class is lost. Parts that are empty, or of one shingle, are
shown only by sets that have more of them than the spare parts (both sets of a pair that no larger part
joins have that many), which keeps them from filling buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import text as tx
from kbspark.llm.stages import by_text, components, partitions, release, settle, sized, spread_join

BITS = 1024  # of a bitmap
CHECK = 4  # family of word hashes that candidates are compared by; sets count as equal if two families agree
BLOCK = 256  # sets of a block
TILES = 256  # a key's last bits are its tile's, whose neighbours so differ
PER_SALT = 128  # comparisons that one copy of a center's text serves


def _bands(percent: int) -> np.ndarray:
    """Upper ends (exclusive) of the size bands: a set and any that links with it lie at most one band apart."""
    ends = [2]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return np.array(ends)


def _parts(upper: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, spare parts, least size of a shown part) of tiles whose smaller sets have fewer than ``upper`` shingles.

    A pair that links differs in at most d shingles. With d + 1 and spare parts, more than the spare ones are
    equal for certain.
    """
    a = upper - 1
    d = (100 - percent) * (a + a * 100 // percent) // (100 + percent)
    spare = 4 + d // 5
    k = np.where(d > 0, d + 1 + spare, 1)
    mean = np.maximum(a * percent // 100, 1) / k
    least = np.where((1 + mean) * np.exp(-mean) * k < spare / 1.6, 2, 1)
    return k, np.where(d > 0, spare, 0), least


def _sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = tx.LOWER[data]
    starts, ends, doc = tx.words(low, offsets, tx.SPACE)
    values, owner = tx.shingles(tx.word_hashes(low, starts, ends, family), doc, rows.num_rows, width)
    return values, owner, np.bincount(owner, minlength=rows.num_rows)


def _in_tile(values: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int, back: int):
    """Of the tile ``back`` bands below each set's own: (tile, spare parts, small parts of each set; values that have parts,
    their parts; of each part its set, number, size, and whether it is small)."""
    bands = _bands(percent)
    tile = np.searchsorted(bands, n, "right") - back
    ok = (n > 0) & (tile >= 0)
    k, spare, least = _parts(bands[np.maximum(tile, 0)], percent)
    k = np.where(ok, k, 0)
    base = np.concatenate([[0], np.cumsum(k)])
    use = ok[owner]
    v, o = values[use], owner[use]
    group = base[o] + ((v >> np.uint64(8)) % k[o].astype(np.uint64)).astype(np.int64)
    size = np.bincount(group, minlength=base[-1])
    who = np.repeat(np.arange(len(k)), k)
    small = (size < least[who]) & (k > 1)[who]
    return tile, spare, np.bincount(who[small], minlength=len(k)), v, group, who, np.arange(base[-1]) - base[who], size, small


def _signatures(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.slices(batch):
                values, owner, n = _sets(rows, data, offsets, width)
                others, whose, _ = _sets(rows, data, offsets, width, CHECK)
                d = rows.num_rows
                bits = np.bincount(owner * BITS + (values >> np.uint64(40)).astype(np.int64) % BITS, minlength=d * BITS).reshape(d, BITS) & 1
                small = [pa.array(_in_tile(values, owner, n, percent, back)[2].astype(np.int32)) for back in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), tx.longs(n), tx.longs(tx.sums(values, owner, d)), tx.longs(tx.sums(others, whose, d)), tx.binaries(np.packbits(bits.astype(np.uint8), axis=1)), *small],
                    ["doc_id", "n_shingles", "f1", "f2", "bitmap", "small0", "small1"],
                )

    return run


def _postings(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.slices(batch):
                values, owner, n = _sets(rows, data, offsets, width)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                for back in (0, 1):
                    tile, spare, few, v, group, who, part, size, small = _in_tile(values, owner, n, percent, back)
                    shown = ~small | (few > spare)[who]
                    key = tx.mix(tx.sums(v, group, len(size)) + tx.mix((tile[who] * (1 << 34) + part).astype(np.uint64)) + size.astype(np.uint64))
                    key = (key & ~np.uint64(TILES - 1)) | (tile[who] % TILES).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([tx.longs(key[shown]), tx.longs(ids[who[shown]])], ["key", "doc"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, doc), the rows of buckets of two and more, with the first doc of the bucket."""
    key = center = None
    for batch in batches:
        k, d = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(k):
            continue
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        head[0] = key is None or k[0] != key
        c = d[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
        if not head[0]:
            run = int(np.argmax(head)) if head.any() else len(k)
            c[:run] = center
        key, center = k[-1], c[-1]
        keep = c != d
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(c[keep]), pa.array(d[keep])], ["key", "center", "doc"])


def _close(n1, n2, xor_bits, percent: int):
    """Whether sets of n1 and n2 that differ in at least xor_bits shingles can reach the similarity."""
    return (n1 + n2 - xor_bits) * (100 + percent) >= 2 * percent * (n1 + n2)


def _enough(small1: list[np.ndarray], small2: list[np.ndarray], own1, own2, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(the tile, modulo TILES, in whose buckets sets of these own bands meet if they link; in how many of them at least).
    small1, small2: small parts in the own tile of each, and in the one below."""
    tile = np.minimum(own1, own2)
    _, spare, _ = _parts(_bands(percent)[tile], percent)
    both = np.minimum(np.where(own1 == tile, *small1), np.where(own2 == tile, *small2))  # that may be equal and not shown
    return tile % TILES, spare + 1 - np.where(both > spare, 0, both)


def _blocks(percent: int):
    """Of rows sorted by bucket and pair of blocks, pairs of different components whose bitmaps allow a link, with the number
    of buckets in which they meet if they do."""
    bands = _bands(percent)

    def compare(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group)
        doc, comp, n, side, *small = (t[c].to_numpy() for c in ("doc", "component", "n", "side", "small0", "small1"))
        own, here = np.searchsorted(bands, n, "right"), t["key"][0].as_py() % TILES
        bits = np.frombuffer(b"".join(t["bitmap"].to_pylist()), np.uint64).reshape(len(doc), BITS // 64)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        a, b = [], []
        for i in left:
            x = np.bitwise_count(bits[right] ^ bits[i]).sum(1, dtype=np.int64)
            ok = right[(comp[right] != comp[i]) & _close(n[right], n[i], x, percent) & ((doc[right] > doc[i]) | (side[i] == 1))]
            a.append(np.full(len(ok), i))
            b.append(ok)
        a, b = (np.concatenate(x).astype(np.int64) for x in (a, b))
        tile, need = _enough([x[a] for x in small], [x[b] for x in small], own[a], own[b], percent)
        ok = tile == here
        a, b = doc[a[ok]], doc[b[ok]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.minimum(a, b), np.maximum(a, b), need[ok])], ["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for s, e in zip([0, *cut], [*cut, len(ids)], strict=True):
                if s == e:
                    continue
                if group and tuple(ids[s]) != last:
                    yield compare(group)
                    group = []
                group.append(batch.slice(s, e - s))
                last = tuple(ids[s])
        if group:
            yield compare(group)

    return run


def _verify(width: int, percent: int):
    """Of texts sorted by center and salt, the center's own first: exact overlaps of sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, its = None, None
        for batch in batches:
            for rows, data, offsets in tx.slices(batch):
                values, owner, n = _sets(rows, data, offsets, width, CHECK)
                ends = np.concatenate([[0], np.cumsum(n)])
                c, d = rows.column(0).to_numpy(), rows.column(2).to_numpy()
                a, b = [], []
                for i in range(len(c)):
                    own = values[ends[i] : ends[i + 1]]
                    if c[i] == d[i]:
                        center, its = c[i], own.copy()
                    elif center == c[i] and len(own) and len(its):
                        small, large = (own, its) if len(own) < len(its) else (its, own)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum())
                        if 100 * both >= percent * (len(own) + len(its) - both):
                            a.append(c[i])
                            b.append(d[i])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _checked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among pairs (a, b). A center's text is sent once for every PER_SALT comparisons."""
    p = partitions(pairs.sparkSession)
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    others = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("d"))
    heads = load.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("d"))
    asked = others.union(heads)
    texts = texts.join(sized(asked.select(F.col("d").alias("doc_id")).distinct()), "doc_id", "left_semi")
    asked = asked.join(texts.select(F.col("doc_id").alias("d"), "text"), "d").select("a", "salt", "d", "text")
    rows = asked.repartition(p, "a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("d"))
    return rows.mapInArrow(tx.tidy(_verify(width, percent)), "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    Words are cut at white space after lower-casing A-Z; a set holds the distinct shingles of ``width``
    words, of a shorter text its whole sequence. Sets link when intersection / union is ``percent`` or
    more. A null, empty or blank text has no shingle and links with nothing; equal sets always link; a
    repeated row gets a row each time, and of different texts of one id the longest is the one that links; null
    doc_ids get a null component; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = settle(texts.mapInArrow(tx.tidy(_signatures(width, percent)), "doc_id long, n_shingles long, f1 long, f2 long, bitmap binary, small0 int, small1 int"), "jaccard-sets")
    known = sig.where("doc_id is not null")
    varied = settle(known.groupBy("doc_id").agg(F.countDistinct("f1", "f2", "n_shingles").alias("n")).where("n > 1").select("doc_id"), "jaccard-varied")
    if not varied.isEmpty():
        longest = settle(texts.join(sized(varied), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text")), "jaccard-longest")
        texts = texts.join(sized(varied), "doc_id", "left_anti").unionByName(longest)
        known = known.join(sized(varied), "doc_id", "left_anti").unionByName(longest.mapInArrow(tx.tidy(_signatures(width, percent)), sig.schema))
    known = known.where("n_shingles > 0")
    classes = known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    equal = spread_join(known.select("doc_id", "n_shingles", "f1", "f2"), classes.where("n > 1"), ["f1", "f2", "n_shingles"], "doc_id").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    equal = settle(equal, "jaccard-equal")

    p = partitions(docs.sparkSession)
    told = equal.select(F.col("b").alias("doc_id")).distinct()  # a class is posted once
    posted = texts.where("doc_id is not null").join(sized(told), "doc_id", "left_anti").mapInArrow(tx.tidy(_postings(width, percent)), "key long, doc long")
    stars = posted.repartition(p, "key").sortWithinPartitions("key", "doc").mapInArrow(tx.tidy(_stars), "key long, center long, doc long")
    stars = settle(stars, "jaccard-buckets")

    told_of = ("n_shingles", "bitmap", "small0", "small1")
    sets = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in told_of)).withColumnRenamed("n_shingles", "n")
    of = lambda end, i: sets.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{c}_{i}") for c in sets.columns[1:]))
    pairs = stars.groupBy(F.col("center").alias("a"), F.col("doc").alias("b"), F.pmod("key", F.lit(TILES)).cast("int").alias("tile")).agg(F.count("*").alias("met"))
    near = pairs.join(of("a", 1), "a").join(of("b", 2), "b").mapInArrow(tx.tidy(_bounded(percent)), "a long, b long, met long, need long")
    near = settle(near, "jaccard-pairs")
    early = near.where("met >= need").select("a", "b")
    links = settle(equal.union(_checked(early, texts, width, percent)), "jaccard-links")
    first = settle(components(links), "jaccard-first")

    # buckets of three and more documents that still hold more than one component
    named = first.select(F.col("node").alias("doc"), "component")
    members = stars.select("key", "doc").union(stars.select("key", F.col("center").alias("doc")).distinct())
    members = members.distinct().join(named, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    members = settle(members, "jaccard-members")
    open_ = members.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("size > 2 and lo < hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(open_, "key").join(sets.withColumnRenamed("doc_id", "doc"), "doc").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "doc", "component", *sets.columns[1:]
    )
    more = spread.repartition(p, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tx.tidy(_blocks(percent)), "a long, b long, need long")
    # what met at centers counts twice where the bucket is still open; a bucket of two is no open one
    met = more.withColumn("met", F.lit(1).cast("long")).unionByName(near.where("met < need")).groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need"))
    more = settle(met.where("met >= need").select("a", "b").join(early, ["a", "b"], "left_anti"), "jaccard-more")
    release(near, stars, members)
    final = named.withColumnRenamed("doc", "doc_id")
    if not more.isEmpty():
        found = settle(_checked(more, texts, width, percent), "jaccard-late")
        if not found.isEmpty():
            final = components(links.union(found)).withColumnRenamed("node", "doc_id")
    return sig.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _bounded(percent: int):
    """Pairs whose bitmaps allow the similarity, in the tile where they meet if they link; need: how often at least."""
    bands = _bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: batch.column(c) for c in batch.schema.names}
            n1, n2 = (t[c].to_numpy() for c in ("n_1", "n_2"))
            m1, m2 = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bitmap_1", "bitmap_2"))
            small1, small2 = ([t[f"small{back}_{i}"].to_numpy() for back in (0, 1)] for i in (1, 2))
            tile, need = _enough(small1, small2, np.searchsorted(bands, n1, "right"), np.searchsorted(bands, n2, "right"), percent)
            ok = pa.array((t["tile"].to_numpy() == tile) & _close(n1, n2, np.bitwise_count(m1 ^ m2).sum(1, dtype=np.int64), percent))
            yield pa.RecordBatch.from_arrays([*(t[c].filter(ok) for c in ("a", "b", "met")), pa.array(need.astype(np.int64)).filter(ok)], ["a", "b", "met", "need"])

    return run


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, of each class only the document with the smallest doc_id. Rows without shingles stay.

    Different texts of one id are documents of their own, which count as larger than ids with one text.
    """
    rows = by_text(docs)
    gone = jaccard_classes(rows, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return rows.join(sized(gone), "doc_id", "left_anti").select("row.*")
