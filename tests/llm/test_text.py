import numpy as np
from common import prose, rows
from pyspark.sql import functions as F

from kbspark.llm import text as tx
from kbspark.llm.ngram_jaccard import dedup, jaccard_classes
from kbspark.llm.ngram_trie import score


def thue_morse(n, a="a", b="b"):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out


def test_hashes_depend_on_the_bytes_of_a_range_alone():
    r = np.random.default_rng(1)
    size = np.array([0, 1, 7, 8, 9, 16, 63, 64, 65, 200, 3, 8])
    data = r.integers(0, 256, size.sum(), dtype=np.uint8)
    ends = np.cumsum(size)
    h = tx.word_hashes(data, ends - size, ends)
    for i, (s, e) in enumerate(zip(ends - size, ends, strict=True)):
        moved = np.concatenate([np.full(5, 255, np.uint8), data[s:e], np.full(3, 254, np.uint8)])
        assert tx.word_hashes(moved, np.array([5]), np.array([5 + e - s]))[0] == h[i]
    assert len(set(h)) == len(h)
    assert not (h == tx.word_hashes(data, ends - size, ends, 4)).any()
    zeros = np.zeros(300, np.uint8)  # ranges of zero bytes differ by their length
    assert len(set(tx.word_hashes(zeros, np.zeros(300, int), np.arange(300)))) == 300


def test_words_that_collide_for_any_polynomial_stay_apart(spark):
    pairs = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (16, 64, 2048, 4096)]
    texts = [t for p in pairs for t in p]
    texts += [prose(3, 50) + " " + t for t in texts[4:6]]  # these do link, by the other words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(jaccard_classes(docs, 4, 85))
    assert [found[i]["component_id"] for i in range(10)] == [*range(8), 8, 8]
    assert {r["doc_id"] for r in dedup(docs).collect()} == set(range(9))
    known = rows(score(docs, F.col("doc_id").isin(1, 3, 5, 7), 2))
    assert [known[i]["n_known"] for i in range(8)] == [2, 1, 2, 1, 2, 2, 2, 1]
