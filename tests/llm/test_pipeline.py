import re

from common import lower
from test_line_dedup import brute as passages

import __spark_entry__
import corpus_pipeline


def sets(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        seen[name] = (before, after)
    # quality classifier: every document whose judged perplexity is above the threshold of its model goes
    from kbspark.llm.quality import classify

    before, after = seen["quality_classifier"]
    judged = {r["doc_id"]: r for r in classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(after) == {i for i, t in before.items() if t and judged[i]["judged"] <= judged[i]["threshold"]}
    # line dedup: every repeated passage goes whole, and what has no writing left
    before, after = seen["line_dedup"]
    ids = sorted(before)
    gone = passages([before[i] for i in ids])
    left = {i: "\n".join(x for k, x in enumerate(before[i].split("\n")) if k not in gone[n]) for n, i in enumerate(ids)}
    assert after == {i: t for n, (i, t) in enumerate(left.items()) if not gone[n] or t.strip(" ")}
    before, after = seen["ngram_jaccard_join"]
    s = {i: sets(t, 5) for i, t in before.items()}
    ids = sorted(before)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if root(i) == i}
    before, after = seen["benchmark_decontamination"]
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"] or "")) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    hit = {i for i, t in before.items() for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))] if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert set(after) == set(before) - hit
    out = {r["doc_id"]: r for r in __spark_entry__.queries()["pipeline"](spark, sf).collect()}
    assert set(out) == set(after) and all(r["lossless"] for r in out.values())
    import sentencepiece

    from kbspark.llm.piece_transducer import MODEL

    encode = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode
    assert all(out[i]["ids"] == encode(t) and out[i]["n_pieces"] == len(out[i]["ids"]) for i, t in after.items())


def test_empty_tables_null_ids_and_ties(spark, tmp_path):
    """All stages of tables with no rows, and of rows with null ids and texts and equal texts."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    body = "\n".join(f"some words of line {k} that go on and on {k * 7}" for k in range(8))
    for name, rows in (("none", []), ("odd", [(1, body, "en", "s", 9), (2, body, "en", "s", 9), (None, body + " x", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)])):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame(rows, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        docs.where("doc_id = 1").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
        docs.limit(0).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r["doc_id"] or 0 for r in found) == ([0, 1] if rows else []) and all(r["lossless"] for r in found)
