import random
import re

import pytest
from common import AWKWARD, frame, lower, prose, rows

from kbspark.llm import ngram_jaccard
from kbspark.llm.ngram_jaccard import dedup, jaccard_classes


def sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(texts, width, percent):
    s = sets(texts, width)
    up = list(range(len(s)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in range(len(s))}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_brute(spark, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 8)
    monkeypatch.setattr(ngram_jaccard, "PER_SALT", 3)
    texts = list(AWKWARD)
    for k, n in enumerate((6, 12, 25, 60, 60, 300, 1500)):
        base = prose(k, n)
        texts += [base, base.upper(), *(edited(base, e, 31 * k + e) for e in (0, 1, 1, 2, 3, 4, 6, 9, 12, 20))]
    chain = prose(99, 120).split()  # each links with the next one only
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 3)]
    passage = prose(7, 60)
    texts += [f"{passage} {prose(500 + i, 8)}" for i in range(40)]
    found = rows(jaccard_classes(frame(spark, texts), width, percent))
    want = brute(texts, width, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    kept = {r["doc_id"] for r in dedup(frame(spark, texts), width, percent).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_empty_and_repeated(spark):
    assert jaccard_classes(frame(spark, [])).count() == 0
    df = frame(spark, ["a b c d e f", "a b c d e f", None])
    out = sorted((r["doc_id"], r["component_id"]) for r in jaccard_classes(df.union(df)).collect())
    assert out == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]


def test_int_null_and_varied_ids_and_a_long_text(spark):
    """Of two texts of an id the largest links; null ids have no class."""
    a, b, long = prose(1, 40), "zz " + prose(2, 40), prose(3, 150_000)
    rows_ = [(1, a), (2, a), (2, b), (3, edited(b, 1, 5)), (None, a), (7, long), (8, long + " end"), (9, prose(4, 30))]
    found = jaccard_classes(spark.createDataFrame(rows_, "doc_id int, text string"), 4, 80).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (1, 1), (2, 2), (2, 2), (3, 2), (7, 7), (8, 7), (9, 9)]


def test_every_pair_at_the_threshold_meets(spark):
    """Large sets that differ in just as many shingles as a link allows are linked, those with one more are not."""
    texts, want = [], {}
    for k, n in enumerate((400, 1500, 4000)):
        words = [f"v{k}x{i}" for i in range(n)]
        size = n - 3
        apart = next(m for m in range(size) if 100 * (size - 4 * (m + 1)) < 85 * (size + 4 * (m + 1)))
        for j, m in enumerate((apart, apart + 1)):
            other = list(words)
            step = (n - 10) // m
            for i in range(m):  # places apart, so that each takes four shingles
                other[5 + i * step] = f"u{k}y{j}z{i}"
            first = len(texts)
            texts += [" ".join(f"{w}{j}" for w in words), " ".join(f"{w}{j}" for w in other)]
            want |= {first: first, first + 1: first if j == 0 else first + 1}
    assert {i: r["component_id"] for i, r in rows(jaccard_classes(frame(spark, texts), 4, 85)).items()} == want


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Large sets, whose bitmaps say nothing, are compared by their texts only if they meet in as many buckets as a link needs."""
    passage = prose(7, 400)
    texts = [f"{passage} {prose(600 + i, 2600 + 10 * i)}" for i in range(40)] + [edited(f"{passage} {prose(639, 2990)}", 30, 1)]
    asked, checked = [], ngram_jaccard._checked
    monkeypatch.setattr(ngram_jaccard, "_checked", lambda pairs, *more: asked.append(pairs.count()) or checked(pairs, *more))
    found = rows(jaccard_classes(frame(spark, texts), 5, 80))
    assert {i: r["component_id"] for i, r in found.items()} == {i: min(i, 39) for i in range(41)}
    assert sum(asked) == 1, asked
