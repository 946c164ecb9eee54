import math
from collections import Counter, defaultdict

import pytest
from common import AWKWARD, frame, prose, rows
from pyspark.sql import functions as F

from kbspark.llm import quality
from kbspark.llm.quality import classify, keep_good


def kneser_ney(texts, order):
    """log p(byte | bytes before) of an interpolated modified Kneser-Ney model, by dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        b = [0] * order + list(t.encode())
        for i in range(order, len(b)):
            counts[order][tuple(b[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / max(k[1] + 2 * k[2], 1)
        cuts[n] = {j: max(0.1, min(j - 0.1, j - (j + 1) * y * k[j + 1] / k[j])) if k[j] else max(0.1, min(j - 0.1, j * 0.5)) for j in (1, 2, 3)}
    after = {n: defaultdict(dict) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            after[n][g[:-1]][g[-1]] = v

    def p(n, h, x):
        if n == 0:
            return 1 / 256
        low = p(n - 1, h[1:], x)
        seen = after[n].get(h)
        if not seen:
            return low
        total, d = sum(seen.values()), cuts[n]
        mass = sum(d[min(v, 3)] for v in seen.values()) / total
        v = seen.get(x)
        return ((v - d[min(v, 3)]) / total if v else 0) + mass * low

    return lambda t: [math.log(p(order, tuple(b[i - order + 1 : i]), b[i])) for b in [[0] * order + list(t.encode())] for i in range(order, len(b))]


def test_perplexity_against_dictionaries(spark):
    texts = [*AWKWARD, *(prose(i, 30, 50) for i in range(30)), "!!??##@@ ZZZZ QQQQ", "ß" * 20]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12, 42)], "doc_id long, quality int, toxic int")
    found = rows(classify(frame(spark, texts), labels))
    model = kneser_ney([t for t in texts[12:42]], quality.ORDER)
    for i, t in enumerate(texts):
        if not t:
            assert found[i]["perplexity"] is None and not found[i]["kept"]
        else:
            lp = model(t)
            assert found[i]["perplexity"] == pytest.approx(math.exp(-sum(lp) / len(lp)), rel=1e-3)
    kept = {r["doc_id"] for r in keep_good(frame(spark, texts), labels).collect()}
    assert set(range(12, 42)) <= kept and 42 not in kept
    assert classify(frame(spark, []), labels).count() == 0
    assert classify(frame(spark, texts), labels.limit(0)).where("kept").count() == sum(bool(t) for t in texts)
    strange = rows(classify(frame(spark, texts).withColumn("lang", F.lit("xx")), labels))
    assert strange[12]["perplexity"] is not None


def test_labels_of_the_tables(spark):
    """Good documents stay, bad ones go; toxic ones of quality 1 are bad, and byte perplexity tells only part of them."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id")
    share = {(r["quality"], r["toxic"]): r["kept"] for r in out.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1, 0] >= 0.98 and share[0, 0] <= 0.05 and share[0, 1] <= 0.05 and share[1, 1] <= 0.5


def test_against_brute_force_decisions(spark):
    """judged, threshold and kept from perplexities by dictionaries, for rows of two languages and of none."""
    texts = [prose(i, 40, 50) for i in range(120)] + [prose(900 + i, 40, 50).replace("w", "zq") for i in range(120)] + ["".join(chr(33 + (7 * i * j) % 90) for j in range(150)) for i in range(40)]
    lang = ["aa"] * 120 + ["bb"] * 120 + ["aa", "bb"] * 20
    labels = {i: int(i < 240) for i in range(280) if i % 4}
    df = frame(spark, texts).drop("lang").join(spark.createDataFrame(list(enumerate(lang)), "doc_id long, lang string"), "doc_id")
    marks = spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")
    found = rows(classify(df, marks))
    held = {r["doc_id"] for r in marks.where(F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(quality.HELD_OUT)) == 0).collect()}
    usual, models = {}, {}
    for m in ("aa", "bb"):
        models[m] = kneser_ney([t for i, t in enumerate(texts) if lang[i] == m and labels.get(i) and i not in held], quality.ORDER)
    logs = [models[lang[i]](t) for i, t in enumerate(texts)]
    for m in models:
        own = [x for i, x in enumerate(logs) if lang[i] == m and labels.get(i) and i in held]
        usual[m] = -sum(map(sum, own)) / sum(map(len, own))
    judged = [(-sum(x) + quality.PRIOR * usual[lang[i]]) / (len(x) + quality.PRIOR) for i, x in enumerate(logs)]
    ratio = {i: judged[i] - usual[lang[i]] for i in labels if i in held or not labels[i]}
    gain = lambda c: sum(r <= c for i, r in ratio.items() if labels[i]) / sum(labels[i] for i in ratio) - sum(r <= c for i, r in ratio.items() if not labels[i]) / sum(not labels[i] for i in ratio)
    best = max(gain(c) for c in ratio.values())
    for i, r in found.items():
        assert r["judged"] == pytest.approx(math.exp(judged[i]), rel=2e-3)
        assert r["kept"] == (r["judged"] <= r["threshold"])
    limit = {m: math.log(next(r["threshold"] for i, r in found.items() if lang[i] == m)) - usual[m] for m in usual}
    assert limit["aa"] == pytest.approx(limit["bb"], abs=2e-3) and gain(limit["aa"]) >= best - 1e-9


def test_model_memory_and_sparse_rows(spark, monkeypatch):
    """Workers that keep one model give the same; ids may be int, null and repeated; a long text is one row."""
    texts = [prose(i, 40, 50) for i in range(30)]
    df = frame(spark, texts).selectExpr("if(doc_id = 29, null, cast(doc_id as int)) doc_id", "text", "if(doc_id % 2 = 0, 'aa', 'bb') lang")
    df = df.union(df.where("doc_id = 3")).union(spark.createDataFrame([(99, prose(5, 150_000, 50), "aa")], "doc_id int, text string, lang string"))
    labels = spark.createDataFrame([(i, 1, None) for i in range(20)], "doc_id int, quality int, toxic int")
    want = sorted((r["doc_id"] or -1, r["perplexity"]) for r in classify(df, labels).collect())
    monkeypatch.setattr(quality, "MODELS_KEPT", 1)
    assert sorted((r["doc_id"] or -1, r["perplexity"]) for r in classify(df, labels).collect()) == want
    assert len(want) == 32 and sum(d == 3 for d, _ in want) == 2 and want[0][0] == -1


def test_toxic_text_is_not_trusted(spark):
    """Toxic documents of quality 1 neither teach the model nor loosen the threshold."""
    shout = [" ".join(w.upper() + "!!" for w in prose(500 + i, 60, 50).split()) for i in range(30)]
    texts = [prose(i, 60, 50) for i in range(150)] + shout
    df = frame(spark, texts)
    labels = [(i, 1, 0) for i in range(150)] + [(150 + i, 1, 1) for i in range(20)]
    found = rows(classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert not any(found[150 + i]["kept"] for i in range(30))
    assert sum(found[i]["kept"] for i in range(150)) >= 145
    clean = rows(classify(df, spark.createDataFrame([x if x[0] < 150 else (x[0], 0, 0) for x in labels], "doc_id long, quality int, toxic int")))
    assert {i: r["perplexity"] for i, r in clean.items()} == pytest.approx({i: r["perplexity"] for i, r in found.items()})


def test_threshold_is_chosen_on_unseen_labels(spark):
    from kbspark.llm.quality import _best

    binned = spark.createDataFrame([(True, b) for b in (0, 1, 2, 3, 40)] + [(False, b) for b in (2, 24, 60, 70)], "good boolean, bin long")
    assert _best(binned) == pytest.approx((3 + 1 + 24) / 2 / quality.BINS)
    assert _best(binned.where("good")) is None


def test_all_trusted_documents_are_fitted(spark, monkeypatch):
    fitted, whole = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda trusted: fitted.append(trusted.count()) or whole(trusted))
    docs = spark.range(4_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de")), (F.col("id") % 3 > 0).cast("int") + 1).alias("lang"))
    labels = spark.range(4_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert classify(docs, labels).count() == 4_500
    assert fitted == [4_500]
