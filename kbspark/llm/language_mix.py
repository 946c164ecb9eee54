"""Language ID by multilingual mixture inference.

Training counts byte trigrams of words per language over all training documents (Spark sums the counts of
the tasks; the table has 65,536 bins a language, whatever the input). A document is a mixture: each of its
words comes from one language, with the likelihood of the word's trigrams. Expectation-maximisation
estimates the proportions; of the nested sets of its best 1, 2, 3 and so on up to all languages the one with
the highest likelihood less a penalty of half the logarithm of the words a free parameter is selected. Larger
sets are left out only once a bound on the likelihood of any mixture shows that none of them can be selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm import text as tx

BINS = 1 << 16
STEPS = 8  # of expectation-maximisation a set
SMOOTH = 0.5
NOISE = 1e-6  # share of words from no language

#: ASCII that is not a letter lies between words; other bytes are parts of words.
_GAP = np.ones(256, bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of words and the trigram bin that ends at each byte, words padded by blanks.

    The first byte of a word sees two blanks, the second one; the blank after a word is left out.
    """
    low = tx.LOWER[data]
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1
    low[latin] += 32  # capitals of Latin-1
    starts, ends, doc = tx.words(low, offsets, _GAP)
    code = low.astype(np.uint32)
    code[_GAP[low]] = 32
    one, two = np.full(len(code), 32, np.uint32), np.full(len(code), 32, np.uint32)
    one[1:], two[2:] = code[:-1], code[:-2]
    one[starts] = two[starts] = 32
    second = starts[ends - starts > 1] + 1
    two[second] = 32
    bins = ((code | one << np.uint32(8) | two << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return starts, ends, doc, bins.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, data, offsets in tx.slices(batch):
            if not len(data):
                continue
            starts, ends, doc, bins = _grams(data, offsets)
            names, lang = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str), return_inverse=True)
            size = ends - starts
            inside = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            owner = np.repeat(lang[doc], size)
            n = np.bincount(owner * BINS + bins[inside], minlength=len(names) * BINS).reshape(len(names), BINS)
            for name, row in zip(names, n, strict=True):
                total[name] = total[name] + row if name in total else row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bin", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods of bins) from docs(lang, text); rows without text or language are passed over."""
    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, bin int, n long")
    table = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()  # at most BINS rows a language
    names, lang = np.unique(np.array(table["lang"].to_pylist(), object).astype(str), return_inverse=True) if table.num_rows else (np.array([], str), np.array([], int))
    n = np.full((len(names), BINS), SMOOTH)
    np.add.at(n, (lang, table["bin"].to_numpy()), table["n"].to_numpy())
    return [str(x) for x in names], np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of documents whose words have likelihoods ``like``, up to a factor a word."""
    share = np.full((len(n), like.shape[1]), 1 / like.shape[1], np.float32)
    for step in range(STEPS + 1):
        r = share[doc] * like
        s = r.sum(1) + np.float32(NOISE)
        if step == STEPS:
            return share, np.add.reduceat(np.log(s), first)
        r /= s[:, None]
        share = np.add.reduceat(r, first, 0) / n[:, None]
        share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
    raise AssertionError


def mixtures(ll: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions) of the selected sets, best first, -1 and 0 where a set is smaller.

    ll: log-likelihoods, words by languages; every document must have a word.
    """
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    top = ll.max(1, keepdims=True)
    like = np.exp(ll - top)
    share, fit = _em(like, doc, first, n)
    s = (share[doc] * like).sum(1) + np.float32(NOISE)
    slope = (np.add.reduceat(like / s[:, None], first, 0) / n[:, None]).max(1) + np.add.reduceat(np.float32(NOISE) / s, first) / n
    upper = fit + n * np.log(np.maximum(slope, 1)) + 0.01  # the logarithm is concave: no mixture has a higher likelihood
    k = ll.shape[1]
    best = np.argsort(-share, 1, kind="stable")
    sets, shares, score = np.full((n_docs, k), -1), np.zeros((n_docs, k)), np.full(n_docs, -np.inf)
    penalty = 0.5 * np.log(n + 1.0)
    for m in range(1, k + 1):
        on = np.flatnonzero(upper - (m - 1) * penalty > score)
        if not len(on):
            break
        place = np.full(n_docs, -1)
        place[on] = np.arange(len(on))
        words = np.flatnonzero(place[doc] >= 0)
        own = np.take_along_axis(like[words], best[doc[words], :m], 1)
        share, fit = _em(own, place[doc[words]], np.concatenate([[0], np.cumsum(n[on])[:-1]]), n[on])
        value = fit - (m - 1) * penalty[on]
        better = value > score[on]
        at = on[better]
        score[at] = value[better]
        sets[at] = -1
        shares[at] = 0
        sets[at, :m], shares[at, :m] = best[at, :m], share[better]
    order = np.argsort(-shares, 1, kind="stable")
    return np.take_along_axis(sets, order, 1), np.take_along_axis(shares, order, 1)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((tx.LOWER[data] >= 97) & (tx.LOWER[data] <= 122))])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    some = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~some & (high[offsets[1:]] > high[offsets[:-1]])):
        some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return some


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        labels = np.array([*names, "und"], object)
        for batch in batches:
            for rows, data, offsets in tx.slices(batch):
                d = rows.num_rows
                lang, score, langs = np.full(d, len(names)), np.zeros(d), np.full(d, "", object)
                some = _has_letter(data, offsets) if names else np.zeros(d, bool)
                if some.any():
                    starts, ends, doc, bins = _grams(data, offsets)
                    ll = np.empty((len(starts), len(names)), np.float32)
                    total = np.zeros(len(data) + 1)
                    for k in range(len(names)):
                        np.cumsum(table[k][bins], dtype=np.float64, out=total[1:])
                        ll[:, k] = total[ends] - total[starts]
                    take = some[doc]
                    who, inner = np.unique(doc[take], return_inverse=True)
                    sets, shares = mixtures(ll[take], inner, len(who))
                    lang[who], score[who] = sets[:, 0], np.clip(shares[:, 0], 0, 1)
                    langs[who] = [",".join(f"{names[l]}:{p:.3f}" for l, p in zip(s, q, strict=True) if l >= 0) for s, q in zip(sets, shares, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(labels[lang].tolist(), pa.string()), pa.array(score), pa.array(langs.tolist(), pa.string())], ["doc_id", "held_out", "lang_pred", "score", "langs"])

    return run


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 where there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs of every row of docs(doc_id, text, lang).

    Learns from rows that are not held out and have text and lang. lang_pred: the largest share of the
    selected set, ``und`` for a null text, one without a letter, or if nothing could be learned; score: that
    share, 0 for ``und``; langs: the set with its shares. Only the text is an input of a prediction. Ties
    go to the language that sorts first. Repeated rows give a row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(train(rows.where("not held_out")))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, langs string")
