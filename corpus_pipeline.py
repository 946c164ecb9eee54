"""A training corpus from raw documents: five stages, each one of the operators of kbspark.llm.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, changed where it changes them; its
result is written as Parquet and read again as the next one's docs. The last returns encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm.decontaminate import remove_documents
from kbspark.llm.line_dedup import clean_documents
from kbspark.llm.ngram_jaccard import dedup
from kbspark.llm.piece_transducer import encode_pieces
from kbspark.llm.quality import keep_good
from kbspark.llm.stages import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language; null and empty texts go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines that repeat earlier ones; those of which nothing is left go."""
    return clean_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share 0.8 of their five-word shingles, the one with the smallest id."""
    return dedup(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, lossless of each document."""
    return encode_pieces(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the classifier and the transducer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
