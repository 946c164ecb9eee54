import itertools
import math
import random
from collections import Counter

from kbspark.operators.segment import UNIT, learned_words, segmented, segmented_tokens

WORDS = ["数据", "知识库", "图", "查询", "向量", "人工智能", "的", "和", "检索"]


def corpus():
    r = random.Random(4)
    return ["".join(r.choice(WORDS) for _ in range(r.randrange(1, 9))) + r.choice([" The ", ", x-y ", "。"]) + "".join(r.choice(WORDS) for _ in range(3)) for _ in range(300)]


def brute_words(texts, least, cohesion):
    import re

    n = Counter()
    for run in itertools.chain.from_iterable(re.findall("[一-鿿]+", t or "") for t in texts):
        n.update(run[i : i + k] for i in range(len(run)) for k in range(1, 5) if i + k <= len(run))
    total = sum(v for w, v in n.items() if len(w) == 1)
    kept = {w: v for w, v in n.items() if len(w) == 1 or (v >= least and all(math.log(v * total / (n[w[:j]] * n[w[j:]])) >= cohesion for j in range(1, len(w))))}
    every = sum(kept.values())
    return {w: (v, math.floor(-math.log(v / every) * UNIT + 0.5)) for w, v in kept.items()}


def brute_path(run, cost, dear):
    ways = []
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        parts = [run[a:b] for a, b in itertools.pairwise(at)]
        if all(p in cost or len(p) == 1 for p in parts):
            ways.append((sum(cost.get(p, dear) for p in parts), len(parts), [-len(p) for p in reversed(parts)], parts))
    return min(ways)[3]


def test_words_and_paths_by_brute_force(spark):
    texts = [*corpus(), None, "", "plain words only"]
    found = learned_words(spark.createDataFrame([(t,) for t in texts], "text string"), cohesion=1.0)
    got = {r["word"]: (r["n"], r["cost"]) for r in found.collect()}
    assert got == brute_words(texts, 5, 1.0)
    assert {w for w in WORDS if len(w) > 1} <= set(got)
    cost = {w: c for w, (_, c) in got.items()}
    r = random.Random(9)
    runs = ["".join(r.choice([*WORDS, "新", "数", "库", "能"]) for _ in range(r.randrange(1, 6)))[:11] for _ in range(150)]
    paths = {x["run"]: x["words"] for x in segmented(spark.createDataFrame([(x,) for x in [*runs, ""]], "run string"), found).collect()}
    assert paths == {x: brute_path(x, cost, max(cost.values()) + UNIT) for x in runs}
    assert segmented(spark.createDataFrame([("新的",)], "run string"), found.where("false")).first()["words"] == ["新", "的"]


def test_tokens_of_rows(spark):
    texts = [*corpus(), None, "", "plain Words only", "知识库" * 3000]
    df = spark.createDataFrame([(i % 300, t, 7) for i, t in enumerate(texts)], "id long, text string, words int")
    words = learned_words(df.where("length(text) < 1000"), cohesion=1.0)
    out = [(r["id"], r["text"], r["tokens"]) for r in segmented_tokens(df, words).collect()]
    assert sorted((i, t or "") for i, t, _ in out) == sorted((i % 300, t or "") for i, t in enumerate(texts))
    for _, text, tokens in out:
        assert "".join(tokens) == "".join((text or "").lower().split())
    told = {t: tokens for _, t, tokens in out}
    assert told["plain Words only"] == ["plain", "words", "only"] and told[None] == [] and told["知识库" * 3000] == ["知识库"] * 3000
    assert learned_words(df.where("false")).count() == 0 and segmented_tokens(df.where("false"), words).count() == 0


def test_registered_query(spark, sf):
    """Every distinct run of letters of the documents is cut into known pieces, without loss."""
    import __spark_entry__

    rows = __spark_entry__.queries()["c11_segments"](spark, sf).collect()
    assert len(rows) > 100 and all(r["words"].replace("|", "") == r["run"] for r in rows)
    assert any("|" in r["words"] for r in rows)
