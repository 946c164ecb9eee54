"""Quality classifier: per-document perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model of bytes, one a language and one of all languages
together for rows whose language has no model. All trusted documents are fitted. Spark
counts n-grams in shards (grouped by language and n-gram, pre-summed by task) and joins the counts with those
of their contexts and of lower orders into smoothed probabilities. A task a model writes its table to the
shared folder; scoring tasks read the tables of the languages that they meet and join them with the n-grams of
their documents. The threshold is chosen on labelled documents outside the fit: the multiple of the usual
perplexity of a language that best tells good from bad ones. Only where labels have no bad documents it is a
quantile, by language, of the good ones.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import text as tx
from kbspark.llm.ngram_trie import filesystem, read_arrays, write_arrays
from kbspark.llm.stages import settle, shared_dir, sized

ORDER = 4
MODELS_KEPT = 12  # models that a worker keeps in memory
HELD_OUT = 5  # one in so many good documents is left out of the fit to choose the threshold
BINS = 1000  # of a unit of log perplexity, in which the threshold is looked for
QUANTILE = 0.995  # without bad labels
SLACK = 1.05  # the threshold lies this factor above the quantile
PRIOR = 64  # bytes of average text that a document is taken to begin with, so that short ones are not judged by chance


def _keys(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes at each byte as one number; bytes before a text are 0, which stands for its start."""
    out = np.zeros(len(data), np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(order):
        b = np.zeros(len(data), np.int64)
        b[k:] = data[: len(data) - k]
        b[place < k] = 0
        out |= b << (8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text), the n-grams of each language."""
    for batch in batches:
        for rows, data, offsets in tx.slices(batch):
            names, lang = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str), return_inverse=True)
            keys, size = _keys(data, offsets, ORDER), np.diff(offsets)
            for k, name in enumerate(names):
                g, n = np.unique(keys[np.repeat(lang == k, size)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(g), pa.string()), pa.array(g), pa.array(n)], ["model", "g", "c"])


def fit(trusted: DataFrame) -> DataFrame:
    """(model, n, g, logp, gamma) from trusted(lang, text), for each language and, of their sums, for all (model ''): for each n-gram its smoothed log-probability, or the log
    weight that it has as a context; the other of them is null."""
    counts = trusted.select("lang", "text").mapInArrow(tx.tidy(_count), "model string, g long, c long")
    own = settle(counts.groupBy("model", "g").agg(F.sum("c").alias("c")), "quality-counts")
    every = own.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit("").alias("model"), "g", "c")
    level = {ORDER: settle(own.where("model <> ''").unionByName(every), "quality-counts")}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the different bytes before
        level[n] = settle(level[n + 1].groupBy("model", F.col("g").bitwiseAND((1 << (8 * n)) - 1).alias("g")).agg(F.count("*").alias("c")), "quality-counts")
    lower, out = None, None
    for n in range(1, ORDER + 1):
        grams = level[n].withColumn("h", F.shiftright("g", 8))
        of = grams.groupBy("model").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        cut = lambda k: F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(k * 0.5)))
        cuts = F.broadcast(of.select("model", *[cut(k).alias(f"d{k}") for k in (1, 2, 3)]))  # one row a model
        grams = grams.join(cuts, "model").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = settle(grams.groupBy("model", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("mass")).withColumn("gamma", F.col("mass") / F.col("total")), "quality-contexts")
        grams = grams.join(contexts, ["model", "h"])
        if lower is None:
            base = F.lit(1 / 256)
        else:
            grams = grams.withColumn("low", F.col("g").bitwiseAND((1 << (8 * (n - 1))) - 1)).join(lower.select("model", F.col("g").alias("low"), F.col("p").alias("q")), ["model", "low"])
            base = F.col("q")
        grams = grams.select("model", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * base).alias("p"))
        lower = settle(grams, f"quality-{n}")
        level_out = lower.select("model", F.lit(n).alias("n"), "g", F.log("p").alias("logp"), F.lit(None).cast("double").alias("gamma"))
        weights = contexts.select("model", F.lit(n - 1).alias("n"), F.col("h").alias("g"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("gamma"))
        out = level_out.union(weights) if out is None else out.union(level_out).union(weights)
    return out


def _write(folder: str):
    """Of all rows of one model, its file: keys, log-probabilities and log weights."""

    def run(t: pa.Table) -> pa.Table:
        name = t["model"][0].as_py()
        full = t["g"].to_numpy() | (t["n"].to_numpy().astype(np.int64) << 40)
        keys, at = np.unique(full, return_inverse=True)
        values = np.full((len(keys), 2), np.nan, np.float32)
        for k, c in enumerate(("logp", "gamma")):
            v = t[c].to_numpy()
            ok = ~np.isnan(v)
            values[at[ok], k] = v[ok]
        path = f"{folder}/model-{hashlib.md5(name.encode()).hexdigest()}"
        write_arrays(path, {"keys": keys, "values": values.ravel()})
        return pa.table([pa.array([name]), pa.array([path])], ["model", "path"])

    return run


_models: OrderedDict[str, tuple[tx.Table, np.ndarray]] = OrderedDict()  # a worker's, those used last at the end


def _model(path: str) -> tuple[tx.Table, np.ndarray]:
    if path not in _models:
        found = read_arrays(path)
        _models[path] = tx.Table(found["keys"]), np.array(found["values"]).reshape(-1, 2)
        while len(_models) > MODELS_KEPT:
            _models.popitem(last=False)
    _models.move_to_end(path)
    return _models[path]


def log_probabilities(model: tuple[tx.Table, np.ndarray] | None, keys: np.ndarray) -> np.ndarray:
    """Log-probability of the last byte of each key after those before it; without a model all bytes are alike."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))

    def joined(full: np.ndarray, column: int) -> np.ndarray:
        table, values = model
        got, at = np.full(len(full), np.nan), table.find(full)
        got[at >= 0] = values[at[at >= 0], column]
        return got

    for n in range(ORDER if model else 0, 0, -1):
        g = keys[todo] & ((1 << (8 * n)) - 1)
        p = joined(g | (n << 40), 0)
        known = ~np.isnan(p)
        out[todo[known]] += p[known]
        todo, g = todo[~known], g[~known]
        if not len(todo):
            return out
        out[todo] += np.nan_to_num(joined((g >> 8) | ((n - 1) << 40), 1))
    out[todo] += np.log(1 / 256)
    return out


def _scores(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = shipped.value
        for batch in batches:
            for rows, data, offsets in tx.slices(batch):
                langs = np.array([x if x in paths else "" for x in rows.column(1).to_pylist()], object).astype(str)
                size = np.diff(offsets)
                keys, p = _keys(data, offsets, ORDER), np.zeros(len(data))
                for lang in np.unique(langs):
                    own = np.repeat(langs == lang, size)
                    p[own] = log_probabilities(_model(paths[str(lang)]) if lang in paths else None, keys[own])
                total = np.concatenate([[0], np.cumsum(p)])
                mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs.tolist(), pa.string()), pa.array(size), pa.array(np.where(size > 0, np.exp(-mean), np.nan), from_pandas=True)], ["doc_id", "model", "n_bytes", "perplexity"])

    return run


def _best(binned: DataFrame) -> float | None:
    """Of binned(good, bin), the log ratio that keeps most of the good less most of the bad; the middle of equals."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = binned.groupBy("bin").agg(count(F.col("good")).alias("good"), count(~F.col("good")).alias("bad")).orderBy("bin").toArrow()  # a row a bin, whatever the input
    at, good, bad = (t[c].to_numpy().astype(np.float64) for c in ("bin", "good", "bad"))
    if not good.sum() or not bad.sum():
        return None
    gain = np.cumsum(good) / good.sum() - np.cumsum(bad) / bad.sum()
    i = int(np.argmax(gain))
    upper = at[i + 1] if i + 1 < len(at) else at[i] + 1
    return float((at[i] + 1 + upper) / 2 / BINS)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, model, n_bytes, perplexity, judged, threshold, kept of every row of docs(doc_id, text, lang).

    Good are documents that every row of labels(doc_id, quality, toxic) gives quality 1 and not toxic 1; other
    labelled ones are bad. Good ones outside the held-out share are trusted to fit the model. ``model`` is the language, or empty for
    the model of all languages (a null lang, or one without trusted text). ``judged`` is the perplexity
    of the text after PRIOR bytes of average trusted text. A document is kept if that is at most the threshold of its model; without a threshold (no trusted text at all) all are.
    A null or empty text has a null perplexity and is not kept. Repeated rows give a row each; other
    columns are ignored.
    """
    spark = docs.sparkSession
    marks = settle(labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.expr("quality = 1 and coalesce(toxic, 0) <> 1")).alias("good")), "quality-marks")
    good = marks.where("good").select("doc_id")
    unseen = F.lit(False) if marks.where("not good").isEmpty() else F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    trusted = rows.where(F.expr("length(text) > 0") & ~unseen).join(sized(good), "doc_id", "left_semi")
    picked = settle(trusted.where("lang is not null"), "quality-trusted")
    folder = f"{shared_dir(spark)}/quality-{uuid.uuid4().hex}"
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    paths = {r["model"]: r["path"] for r in fit(picked).groupBy("model").applyInArrow(_write(folder), "model string, path string").collect()}  # one row a language
    shipped = spark.sparkContext.broadcast(paths)
    scored = settle(rows.select("doc_id", "lang", "text").mapInArrow(tx.tidy(_scores(shipped)), "doc_id long, model string, n_bytes long, perplexity double"), "quality-scores")
    known = scored.where("perplexity is not null").join(sized(marks), "doc_id").join(sized(picked.select("doc_id").distinct().withColumn("fitted", F.lit(True))), "doc_id", "left").withColumn("fitted", F.col("fitted").isNotNull())
    known = settle(known, "quality-known")
    mean = lambda which: F.sum(F.when(which, F.col("n_bytes") * F.log("perplexity"))) / F.sum(F.when(which, F.col("n_bytes")))
    usual = known.where("good").groupBy("model").agg(F.coalesce(mean(~F.col("fitted")), mean(F.lit(True))).alias("usual"))
    judged = lambda df: df.join(F.broadcast(usual), "model", "left").withColumn("judged", F.exp((F.col("n_bytes") * F.log("perplexity") + PRIOR * F.col("usual")) / (F.col("n_bytes") + PRIOR)))  # noqa: E731  one row a language
    best = _best(judged(known).where("not fitted and usual is not null").select("good", F.floor((F.log("judged") - F.col("usual")) * BINS).alias("bin")))
    if best is None:
        limits = judged(known.where("good")).groupBy("model").agg((F.percentile_approx("judged", QUANTILE, 10000) * SLACK).alias("threshold"))
    else:
        limits = usual.select("model", F.exp(F.col("usual") + best).alias("threshold"))
    out = judged(scored).join(F.broadcast(limits), "model", "left")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("judged") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "model", "n_bytes", "perplexity", "judged", "threshold", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps; null and empty texts go, and of rows that share an id all or none. Rows
    with a null id are kept if they have text."""
    gone = classify(docs, labels).where("not kept and n_bytes > 0 and doc_id is not null").select("doc_id").distinct()
    return docs.where("length(text) > 0").join(sized(gone), "doc_id", "left_anti").select(*docs.columns)
