import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from common import AWKWARD, frame

from kbspark.llm import histogram_sort
from kbspark.llm.histogram_sort import FIRST, _arrays, place, shard_rows, write_shards


def held(out, docs, shards=16, tolerance=0.001):
    """Checks the contract of rows and the law; returns rows by shard."""
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)
    by = defaultdict(list)
    for r in out:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    total, most = sum(r["size"] for r in out), max((r["size"] for r in out), default=0)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= 2 * max(tolerance * total / shards, most) + 1
    return by


def test_hot_group_long_texts_ties_and_nulls(spark):
    r = random.Random(5)
    texts = [*AWKWARD, *["the same text"] * 700, *[" ".join(r.choice("abcdefg") * 3 for _ in range(r.randrange(1, 60))) for _ in range(1200)], "long " * 3000]
    docs = list(enumerate(texts))
    out = shard_rows(frame(spark, texts)).collect()
    by = held(out, docs)
    assert sorted(x["doc_id"] for x in out) == [d for d, _ in docs]
    again = {x["doc_id"]: (x["shard"], x["slot"]) for x in shard_rows(frame(spark, texts).repartition(3)).collect()}
    assert again == {x["doc_id"]: (x["shard"], x["slot"]) for x in out}  # whatever the partitions are
    assert len([s for s in by if any(x["text_crc32"] == zlib.crc32(b"the same text") for x in by[s])]) <= 4


def test_small_groups_stay_together(spark):
    texts = [f"text {k // 3} " * 5 for k in range(6000)]
    out = shard_rows(frame(spark, texts), shards=4, tolerance=0.01).collect()
    held(out, list(enumerate(texts)), 4, 0.01)
    of = defaultdict(set)
    for r in out:
        of[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_one_row_many_times_few_rows_and_none(spark):
    same = [(1, "again and again")] * 900 + [(None, None)] * 100 + [(None, "")] * 50
    out = shard_rows(spark.createDataFrame(same, "doc_id int, text string"), shards=5).collect()
    held(out, same, 5)
    assert Counter(r["doc_id"] for r in out) == {1: 900, None: 150}
    few = [(k, "x" * k) for k in range(3)]
    held(shard_rows(spark.createDataFrame(few, "doc_id long, text string")).collect(), few)
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [f"text {k}" for k in range(300)]).withColumnRenamed("n", "shard").withColumnRenamed("at", "slot")
    write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("document.*").columns == docs.columns and back.count() == 300
    assert back.groupBy("shard").count().count() == 3
    assert sorted(back.select("document.*").collect()) == sorted(docs.collect())


def test_place_and_number_of_passes(spark):
    r = np.random.default_rng(1)
    key, row = r.integers(-3, 3, 500), r.integers(0, 4, 500)
    rank = [((int(k) + (1 << 63)) << 64) + int(x) for k, x in zip(key, row, strict=True)]
    cuts = sorted(set(rank[:40]) | {FIRST + 5})
    assert place(key, row, *_arrays(cuts)).tolist() == [sum(c <= x for c in cuts) for x in rank]
    texts = [f"row {k} " * (k % 7) for k in range(5000)]
    docs = frame(spark, texts)
    rows = docs.select(histogram_sort.sort_key(docs.text, docs.doc_id).alias("key"), docs.doc_id.alias("row"), docs.n_chars.alias("size"))
    assert histogram_sort.find_splits(rows, 8, 2, 0.01).passes <= 6
