"""The queries of the operators and of the pipeline, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.ngram_jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.language_mix import remainder
    from kbspark.llm.ngram_trie import score

    return score(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.language_mix import identify, remainder

    return identify(_table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.piece_transducer import encode_pieces

    return encode_pieces(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.frames import fill_in_middle, store

    out = fill_in_middle(store(_table(spark, sf_dir, "documents")), seed=42, rate=50, spm=80, with_frames=False)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.block_max import build_index, search

    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=50)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.llm.histogram_sort import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"), shards=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from kbspark.llm.oracles import SQL

    return dict(SQL)
