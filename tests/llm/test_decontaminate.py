import re

import pytest
from common import AWKWARD, frame, lower, prose, rows, sha

from kbspark.llm import decontaminate
from kbspark.llm.decontaminate import contamination, remove_documents


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def brute(texts, items, width):
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(width, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v and item is not None else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


@pytest.mark.parametrize("hashes,windows", [(3, 3), (10**6, 3), (10**6, 10**6)])
def test_brute(spark, hashes, windows, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_HASHES", hashes)
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", windows)
    items = [(1, prose(1, 30)), (2, prose(1, 30) + " tail"), (10, "Éa b, C-d 5 5"), (3, None), (None, prose(5, 20)), (4, "..."), (5, "one"), (7, prose(2, 11)), (8, "a b c d e f g h i j")]
    texts = [*AWKWARD, f"x {items[0][1].upper()}!! y", prose(1, 9), prose(1, 10), f"{prose(2, 11)} q {prose(2, 11)}", "éa b c d 5 5", "Éa;B;c;D;5;5;5", prose(5, 20), "a b c d e f g h i j " * 3]
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = rows(contamination(frame(spark, texts), df, 10))
    want = brute(texts, items, 10)
    assert {i: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i, r in found.items()} == want
    clean = remove_documents(frame(spark, texts), df, 10)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in want.items() if not r[4]}
    assert contamination(frame(spark, []), df).count() == 0
    none = contamination(frame(spark, texts), df.limit(0))
    assert none.count() == len(texts) and none.where("contaminated").isEmpty()


def test_repeated_and_null_ids_and_long_texts(spark):
    """Rows of one id are one row of the report, null ids one more; the stage removes by text; a long text with very many hits ends in seconds."""
    item = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "tie")], "item_id long, text string")
    rows_ = [(1, "x a b c d e f g h i j"), (1, "y z"), (None, "tie"), (None, "q"), (2, "tie no " * 60_000)]
    for kind in ("long", "int"):
        found = {r["doc_id"]: r for r in contamination(spark.createDataFrame(rows_, f"doc_id {kind}, text string"), item).collect()}
        assert (found[1]["n_words"], found[1]["n_hit"]) == (11, 10) and found[None]["n_hit"] == 1 and found[2]["n_hit"] == 60_000
    left = remove_documents(spark.createDataFrame(rows_, "doc_id long, text string"), item)
    # a clean text stays beside a contaminated one of its id; rows without an id stay
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "q"), (0, "tie"), (1, "y z")]
