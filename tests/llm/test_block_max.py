import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from common import AWKWARD, frame, lower

from kbspark.llm import block_max
from kbspark.llm.block_max import blocks_read, build_index, from_var_bytes, search, var_bytes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    own = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lower(text or "")))
        scores = []
        for d, c, size in own:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def found(spark, docs, items, k, **index):
    ix = build_index(docs, **index)
    return Counter(tuple(r) for r in search(ix, items, k).collect()), ix


@pytest.fixture
def corpus(spark):
    r = random.Random(9)
    texts = [*AWKWARD, *[" ".join(f"w{int(r.random() ** 3 * 300)}" for _ in range(r.randrange(1, 80))) for _ in range(900)], *["w1 w2 w3 w200"] * 300, "w5 " * 5000, "Wé1_w1-W2"]
    r.shuffle(texts)
    items = [(k, " ".join(f"w{int(r.random() ** 2 * 320)}" for _ in range(r.randrange(1, 12)))) for k in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (33, "W1 w1 WÉ1"), (33, "one"), (None, "two three")]
    return texts, items


@pytest.mark.parametrize("shard_docs, block", [(8192, 128), (1, 4)])
def test_brute(spark, corpus, monkeypatch, shard_docs, block):
    monkeypatch.setattr(block_max, "SEED_SHARDS", 2)
    texts, items = corpus
    docs, queries = frame(spark, texts).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 50):
        got, _ = found(spark, docs, queries, k, shard_docs=shard_docs, block=block)
        assert got == brute(list(enumerate(texts)), items, k)


def test_several_jobs_repeated_and_null_ids_and_none(spark, corpus, monkeypatch):
    monkeypatch.setattr(block_max, "QUERY_TERMS", 40)
    texts, items = corpus
    docs = [(k % 7 or None, t) for k, t in enumerate(texts[:300])]
    frame_ = spark.createDataFrame(docs, "doc_id int, text string")
    queries = spark.createDataFrame(items, "item_id int, text string")
    assert found(spark, frame_, queries, 10)[0] == brute(docs, items, 10)
    assert not found(spark, frame_.limit(0), queries, 10)[0]
    assert not found(spark, frame_, queries.limit(0), 10)[0]
    assert not found(spark, spark.createDataFrame([(1, None), (2, "..")], "doc_id int, text string"), queries, 10)[0]


def test_long_text_in_pieces(spark):
    docs = [(1, "é1 w2 " * 300_000), (2, "x" * 1_500_000 + " w2"), (3, "w2 w3")]
    items = [(1, "w2"), (2, "é1"), (3, "x" * 1_500_000)]
    got, _ = found(spark, spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), 10)
    assert got == brute(docs, items, 10)


def test_blocks_are_rejected_before_decompression(spark):
    r = random.Random(2)
    texts = [" ".join(["common", "frequent"] * r.randrange(1, 3) + [f"w{r.randrange(3000)}" for _ in range(20)]) for _ in range(20_000)]
    items = [(k, f"common frequent w{k} w{k + 1}") for k in range(20)]
    docs, queries = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got, index = found(spark, docs.repartition(2), queries, 5, shard_docs=1024)
    assert got == brute(list(enumerate(texts)), items, 5)
    read, there = blocks_read(index, queries, 5)
    assert 0 < read < there / 2


def test_variable_bytes():
    x = np.random.default_rng(3).integers(0, 1 << 40, 2000) >> np.random.default_rng(4).integers(0, 40, 2000)
    data, size = var_bytes(x)
    assert size.sum() == len(data) and (from_var_bytes(data) == x).all()
    assert len(var_bytes(np.zeros(0, np.int64))[0]) == 0 and len(from_var_bytes(np.zeros(0, np.uint8))) == 0
