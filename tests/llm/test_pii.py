import random
import re

from common import AWKWARD, frame, rows, sha

from kbspark.llm.pii import find_pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(RULES.items()) for m in re.finditer(p, text) if ok(kind, m[0]))
    return [(a, list(RULES)[k], b) for a, k, b in found]


def cases():
    r = random.Random(5)
    bits = ["a", "b.c", "@", ".", "-", "x@y.z", "+", "+1 ", "(771) 555", "-1655", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "256.1.1.1", "0", "00", "7", " ", "  ", "é", "\U0001f600", "\n", "_", "%", "12-34", "call ", "john.doe@mail.example.com"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(400)]


def test_brute(spark):
    texts = [*AWKWARD, *cases(), "a@b.c.@d.e", "1.2.3.4.5.6.7.8.9", "1" * 5000, "x" * 5000 + "@y.z", "1 " * 4000, "+1" + " " * 3000 + "2", "+1-800-555-0199 and +44 20 7946 0958"]
    found = rows(find_pii(frame(spark, texts)))
    for i, t in enumerate(texts):
        want = brute(t or "")
        base = [f"{k}:{a}:{b}" for a, k, b in want]
        r = found[i]
        assert r["base_sha256"] == sha(",".join(base)), (t, r["spans"], base)
        assert set(base) <= set(r["spans"].split(","))or not base
        assert [r[f"n_{k}"] for k in RULES] == [sum(w[1] == k for w in want) for k in RULES]


def test_added(spark):
    lines = [f"Patient Dr. Maria Lopez, call (415) {200 + i}-{1000 + i}, ssn 123-45-{6000 + i}, mail a{i}@b.com, tel +1 (771) 555-{1000 + i}" for i in range(50)]
    clean = [f"version 123-45-67 of chapter {i}, order {i}00-2" for i in range(50)]
    found = rows(find_pii(frame(spark, lines + clean)))
    assert all(found[i]["n_added"] >= 1 for i in range(50))
    assert all(found[i]["spans"] == "" for i in range(50, 100))
    assert find_pii(frame(spark, [])).count() == 0


def test_classifier_against_brute_force(spark):
    """Expectation-maximisation over every candidate by itself, and a decision for each from its posterior."""
    import math

    from pyspark.sql import functions as F

    from kbspark.llm import pii

    lines = [f"Patient Dr. Maria Lopez, call (415) {200 + i}-{1000 + i}, ssn 123-45-{6000 + i}, mail a{i}@b.com, tel +1 (771) 555-{1000 + i}" for i in range(50)]
    lines += [f"order 4111 1111 1111 {1000 + 7 * i}, version 1.2.{300 + i}.4, isbn 978-0-{i}" for i in range(80)] + [f"from {i}.2.3.4 pay 4111111111111111" for i in range(40)]
    df = frame(spark, lines)
    each = [(r["x"]["kind"], tuple(r["x"][v] for v in pii.LABELERS), r["x"]["base"]) for r in pii.candidates(df).select(F.explode("spans").alias("x")).collect()]
    kinds = sorted({k for k, _, _ in each})
    share = dict.fromkeys(kinds, 0.5)
    yes = [[{-1: (wrong if c else right), 0: 1 - right - wrong, 1: (right if c else wrong)} for c in (0, 1)] for right, wrong in (pii.START[name] for name in pii.LABELERS)]

    def p(k, votes):
        a, b = share[k], 1 - share[k]
        for i, v in enumerate(votes):
            a, b = a * yes[i][1][v], b * yes[i][0][v]
        return a / (a + b)

    for _ in range(30):
        post = [p(k, votes) for k, votes, _ in each]
        share = {k: (1 + sum(q for q, e in zip(post, each) if e[0] == k)) / (2 + sum(e[0] == k for e in each)) for k in kinds}
        for i in range(len(pii.LABELERS)):
            n = [{v: 0.5 + sum((q if c else 1 - q) for q, e in zip(post, each) if e[1][i] == v) for v in (-1, 0, 1)} for c in (0, 1)]
            yes[i] = [{v: n[c][v] / sum(n[c].values()) for v in n[c]} for c in (0, 1)]
            for v in (-1, 1):
                if (yes[i][1][v] - yes[i][0][v]) * v < 0:
                    yes[i][1][v] = yes[i][0][v] = (yes[i][1][v] + yes[i][0][v]) / 2
    counted = {}
    for k, votes, _ in each:
        counted[k, votes] = counted.get((k, votes), 0) + 1
    got_share, got_chance = pii.reliabilities([(k, v, float(n)) for (k, v), n in counted.items()])
    for k, votes, _ in each:
        assert math.isclose(pii.posterior(got_share[k], got_chance, votes), p(k, votes), abs_tol=1e-6)
    decide = pii.train(pii.candidates(df).select("spans"))
    scored = pii.candidates(df).select(F.explode("spans").alias("x")).select("x.*", decide(F.col("x")).alias("p")).collect()
    same = [(r["p"] >= 0.9) == (p(r["kind"], tuple(r[v] for v in pii.LABELERS)) >= 0.9) for r in scored]
    assert sum(same) >= 0.97 * len(same)
    found = rows(find_pii(df))
    assert all("national" in found[i]["spans"] and "identity" in found[i]["spans"] for i in range(50))
    assert all(found[i]["n_added"] == 0 for i in range(50, 130))


def test_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square; ids may be int, null and repeated."""
    import time

    began = time.time()
    text = "1.2.3.4 " * 100_000
    found = find_pii(spark.createDataFrame([(1, text), (None, "a@b.com"), (None, "a@b.com")], "doc_id int, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_ip"], r["n_email"]) for r in found) == [(0, 0, 1), (0, 0, 1), (1, 100_000, 0)]
    base = ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(100_000))
    assert next(r for r in found if r["doc_id"])["base_sha256"] == sha(base)
    assert time.time() - began < 120


def test_many_accepted_spans_beside_base_spans(spark):
    """Accepted spans of a text with as many base spans are held against these in less than their product; none overlaps one."""
    import time

    lines = [f"Patient Dr. Maria Lopez, call (415) {200 + i}-{1000 + i}, ssn 123-45-{6000 + i}, mail a{i}@b.com, tel +1 (771) 555-{1000 + i}" for i in range(50)]
    n = 30_000
    long = "".join(f"call (415) {200 + i % 700}-{1000 + i % 9000}, mail a@b.com\n" for i in range(n))
    began = time.time()
    found = rows(find_pii(frame(spark, [*lines, long])))[50]
    assert (found["n_email"], found["n_added"]) == (n, n)
    spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in found["spans"].split(","))]
    assert len(spans) == 2 * n and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert time.time() - began < 60


def test_binary_search(spark):
    from pyspark.sql import functions as F

    from kbspark.llm.pii import _below

    arrays = [[], [3], [1, 1, 2, 5, 5, 9], list(range(0, 200, 3))]
    df = spark.createDataFrame([(a, v) for a in arrays for v in (-1, 0, 1, 2, 5, 6, 9, 10, 198, 500)], "a array<int>, v int")
    assert all(r["n"] == sum(x < r["v"] for x in r["a"]) for r in df.withColumn("n", _below("a", F.col("v"))).collect())
