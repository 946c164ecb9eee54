from common import AWKWARD, frame, prose, rows
from pyspark.sql import functions as F

from kbspark.llm.line_dedup import clean_documents, dedup_lines


def test_shared_passages_and_copies(spark):
    lines = [" ".join(prose(k, 12).split()) for k in range(400)]
    passage = lines[:12]
    texts = [*AWKWARD, "\n".join(lines[20:40])]
    for i in range(12):  # a passage at another place between lines of their own
        own = lines[50 + 25 * i : 70 + 25 * i]
        texts.append("\n".join(own[: i % 5 + 3] + passage + own[i % 5 + 3 :]))
    texts += [texts[len(AWKWARD)], "\n".join(lines[20:40]) + "\nmore", "", None]
    df = frame(spark, texts)
    found = rows(dedup_lines(df))
    first = len(AWKWARD)
    for i, t in enumerate(texts):
        left = found[i]["text"]
        if t is None:
            assert left is None and found[i]["n_lines"] == 0
            continue
        have = t.split("\n")
        assert found[i]["n_lines"] == len(have) and len(left.split("\n") if left else []) >= len(have) - found[i]["n_removed"] - 1
        if i < first + 2:
            assert left == t  # the first occurrence of anything stays
        elif i < first + 13:
            own = [x for x in have if x not in passage]
            assert [x for x in left.split("\n") if x not in passage] == own  # nothing of its own goes
            assert sum(x in passage for x in left.split("\n")) <= 5
    assert found[first + 13]["n_removed"] >= 18  # a copy: all but lines that no seed chunks with a neighbour
    cleaned = {r["doc_id"]: r for r in clean_documents(df).collect()}
    assert cleaned[first]["n_chars"] == len(texts[first])
    assert clean_documents(df).columns == df.columns
    assert dedup_lines(frame(spark, [])).count() == 0


def test_hash_hits_are_compared(spark, monkeypatch):
    """With hashes of two bits nearly all windows collide; still none goes that does not occur earlier."""
    from kbspark.llm import line_dedup

    texts = ["\n".join(" ".join(prose(100 * i + k, 5).split()) for k in range(6)) for i in range(30)]
    texts += ["\n".join(["own line"] + texts[i].split("\n")[:3]) for i in range(0, 30, 3)]
    want = brute(texts)
    monkeypatch.setattr(line_dedup, "MASK", 1)
    found = rows(line_dedup.dedup_lines(frame(spark, texts)))
    gone = 0
    for d, t in enumerate(texts):
        left = [x for i, x in enumerate(t.split("\n")) if i not in want[d]]
        have = found[d]["text"].split("\n")
        assert [x for x in have if x in left] == left
        gone += found[d]["n_removed"]
    monkeypatch.setattr(line_dedup, "MASK", -1)
    exact = rows(line_dedup.dedup_lines(frame(spark, texts)))
    assert gone < sum(r["n_removed"] for r in exact.values()) == sum(map(len, want.values())) == 30


def test_int_null_repeated_ids_and_a_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    rows_ = [(1, "a\nb"), (1, "a\nb"), (2, "x\na\nb"), (None, "a\nb"), (5, long), (6, "own\n" + long)]
    df = spark.createDataFrame(rows_, "doc_id int, text string")
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in dedup_lines(df).collect())
    assert found == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 3, 2), (5, 100_000, 0), (6, 100_001, 100_000)]
    assert sorted(r["doc_id"] or 0 for r in clean_documents(df.withColumn("n_chars", F.length("text").cast("long"))).collect()) == [0, 1, 1, 2, 5, 6]


def brute(texts):
    """Line indices that go: those of passages of two and more written lines that occur earlier without overlap."""
    seen, gone = {}, {}
    for d, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        w = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        drop = set()
        for a, b in zip(w, w[1:], strict=False):
            at = seen.setdefault(tuple(lines[a : b + 1]), (d, a, b))
            if at[0] < d or at[2] < a:
                drop |= set(range(a, b + 1))
        for i in range(len(lines)):
            before, after = max([x for x in w if x < i], default=None), min([x for x in w if x > i], default=None)
            if drop and i not in w and all(x is None or x in drop for x in (before, after)):
                drop.add(i)
        gone[d] = drop
    return gone


def test_every_repeated_passage_goes_whole(spark):
    """Short passages between foreign lines, with blank lines, at the edges, many times, and lines that repeat themselves."""
    import random

    r = random.Random(7)
    own = iter([" ".join(prose(1000 + k, 6).split()) + f" {k}" for k in range(4000)])
    texts = []
    for size in (2, 3, 4, 8):
        for copies in (2, 2, 2, 2, 2, 2, 50):
            passage = [next(own) for _ in range(size)]
            if r.random() < 0.4:
                passage.insert(1, r.choice(["", " \t"]))
            for _ in range(copies):
                texts.append("\n".join([next(own) for _ in range(r.randrange(4))] + passage + [next(own) for _ in range(r.randrange(4))]))
    texts += ["tie\ntie", "tie\ntie\ntie", "z\nz\nz", "q\nq\nq\nq", "q\n\nq\n", *AWKWARD, "one\n\n\ntwo\n", "\none\n\n\ntwo\n\n", "one\n\ntwo"]
    r.shuffle(texts)
    found, want = rows(dedup_lines(frame(spark, texts))), brute(texts)
    for d, t in enumerate(texts):
        assert found[d]["n_removed"] == len(want[d])
        assert found[d]["text"] == (t if not want[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))
    assert sum(map(len, want.values())) > 900
