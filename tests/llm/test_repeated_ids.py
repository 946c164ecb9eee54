"""Different texts of one id are documents of their own, in every stage, with columns of any name."""

import pytest
from common import prose

from kbspark.llm.decontaminate import remove_documents
from kbspark.llm.line_dedup import clean_documents, dedup_lines
from kbspark.llm.ngram_jaccard import dedup

CLASH = ["gone", "N_LINES", "n_removed", "component", "T", "row", "listed", "h1", "salt", "keeper", "bitmap"]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, len(t or ""), *range(len(CLASH))) for d, t in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH))


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_line_dedup(spark):
    rows = [(1, "a one\nb two"), (2, "a one\nb two"), (2, "x never seen\ny never seen"), (2, "own\na one\nb two"), (None, "a one\nb two"), (3, None), (3, "")]
    docs = frame(spark, rows)
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["text"]) for r in dedup_lines(docs).where("text <> ''").collect()) == [(0, 0, "a one\nb two"), (1, 0, "a one\nb two"), (2, 0, "x never seen\ny never seen"), (2, 2, "own")]
    kept = clean_documents(docs)
    assert kept.schema == docs.schema
    assert texts(kept) == sorted([(1, "a one\nb two"), (2, "x never seen\ny never seen"), (2, "own"), (None, "a one\nb two"), (3, None), (3, "")], key=str)
    assert {tuple(r[c] for c in CLASH) for r in kept.collect()} == {tuple(range(len(CLASH)))}


def test_jaccard(spark):
    long = prose(1, 80)
    rows = [(1, long), (2, long + " more"), (2, prose(2, 60)), (2, prose(2, 60)), (3, prose(3, 40)), (3, long), (4, None), (None, long)]
    docs = frame(spark, rows)
    kept = dedup(docs)
    assert kept.schema == docs.schema
    assert texts(kept) == sorted([(1, long), (2, prose(2, 60)), (2, prose(2, 60)), (3, prose(3, 40)), (4, None), (None, long)], key=str)


def test_decontamination(spark):
    item = prose(9, 10)
    rows = [(1, "x " + item), (1, prose(5, 30)), (2, item), (3, None), (None, prose(6, 10)), (4, prose(7, 12))]
    docs = frame(spark, rows)
    kept = remove_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.schema == docs.schema
    assert texts(kept) == sorted([(1, prose(5, 30)), (3, None), (None, prose(6, 10)), (4, prose(7, 12))], key=str)


@pytest.mark.parametrize("stage", [clean_documents, dedup])
def test_empty(spark, stage):
    assert stage(frame(spark, [])).count() == 0
