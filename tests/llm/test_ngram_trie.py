import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from common import AWKWARD, frame, lower, prose, rows

from kbspark.llm import ngram_trie
from kbspark.llm.elias_fano import EliasFano
from kbspark.llm.language_mix import remainder
from kbspark.llm.ngram_trie import score


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**12), (1000, 50), (1000, 10**9), (5000, 2**62), (300, 301)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n + 1)
    v = np.sort(r.integers(0, top, n).astype(np.uint64))
    e = EliasFano.of(v)
    assert (e.get(np.arange(n)) == v).all()
    ask = np.concatenate([v, v + np.uint64(1), r.integers(0, top + 5, 200).astype(np.uint64)])
    at, equal = e.successor(ask)
    assert (at == np.searchsorted(v, ask)).all()
    assert (equal == np.isin(ask, v)).all()


def brute(texts, order):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    grams = [Counter() for _ in range(order + 1)]
    after = defaultdict(Counter)
    for w, h in zip(toks, held, strict=True):
        if not h:
            full = [None, *w]
            grams[1].update((x,) for x in w)
            for k in range(2, order + 1):
                for i in range(1, len(full)):
                    if i - k + 1 >= 0:
                        g = tuple(full[i - k + 1 : i + 1])
                        grams[k][g] += 1
                        after[g[:-1]][g[-1]] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    one = lambda x: (grams[1][(x,)] + 1) / (n + v + 1)

    def p(h, x):
        if not h:
            return one(x)
        if (*h[1:], x) and not after.get(h):
            return p(h[1:], x)
        total, kinds = sum(after[h].values()), len(after[h])
        return max(after[h][x] - 0.75, 0) / total + 0.75 * kinds / total * p(h[1:], x)

    out = {}
    for i, w in enumerate(toks):
        full = [None, *w]
        s = sum(math.log10(p(tuple(full[max(0, j - order + 1) : j]), full[j])) for j in range(1, len(full)))
        out[i] = (held[i], len(w), sum(grams[1][(x,)] > 0 for x in w), n, sum(math.log10(one(x)) for x in w), s)
    return out


@pytest.mark.parametrize("order,per_salt", [(2, 10**6), (3, 10**6), (2, 60), (3, 60)])
def test_brute(spark, order, per_salt, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD_CHARS", 800)
    monkeypatch.setattr(ngram_trie, "PER_SALT", per_salt)  # some shards are hot, or none
    texts = [*AWKWARD, *(prose(i, 5 + 7 * i, 60) for i in range(40)), prose(3, 26, 60), None, ""]
    found = rows(score(frame(spark, texts), remainder("doc_id", 7) == 2, order))
    for i, want in brute(texts, order).items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4]
        assert r["base_score"] == pytest.approx(want[4], abs=1e-9)
        assert r["score"] == pytest.approx(want[5], abs=2e-4 * order * want[1])
    assert score(frame(spark, []), remainder("doc_id", 7) == 2).count() == 0


def test_shards_that_are_read_are_kept_in_bounds(tmp_path, monkeypatch):
    from kbspark.llm.ngram_trie import Level, read_arrays, write_arrays

    for s in range(4):
        write_arrays(f"file://{tmp_path}/level1-{s}", {"count": np.arange(1000) + s})
    monkeypatch.setattr(ngram_trie, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(ngram_trie, "read_arrays", lambda uri: {k: np.array(v) for k, v in read_arrays(uri).items()})
    level = Level(f"file://{tmp_path}", 1, [0, 1, 2, 3], [0, 1, 2, 3], [1000] * 4, 0)
    for s in (0, 1, 2, 3, 0, 3, 3, 1):
        assert level.shard(s)["count"][0] == s and level._held <= 20_000 and len(level._open) <= 2


def test_int_null_repeated_ids_and_a_long_text(spark):
    rows_ = [(1, "a b"), (1, "a b"), (None, "a"), (8, prose(1, 150_000))]
    found = score(spark.createDataFrame(rows_, "doc_id int, text string"), F.lit(False), 2).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == [(0, 2), (1, 3), (1, 3), (8, 150_001)]


def test_the_query_scores_by_words_two_before(spark, tmp_path):
    from kbspark.llm.queries import op3_lm_scoring

    texts = [prose(i, 200, 30) for i in range(30)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found, want = rows(op3_lm_scoring(spark, str(tmp_path))), brute(texts, 3)
    assert all(found[i]["score"] == pytest.approx(r[5], abs=6e-4 * r[1]) for i, r in want.items())
    lower_order = brute(texts, 2)
    assert any(abs(lower_order[i][5] - r[5]) > 6e-4 * r[1] for i, r in want.items())
