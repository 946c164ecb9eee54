"""Parsing what a model has written, as corpus jobs (P12, P13), and schema maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import strip

# Delimiters of extraction records.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"


def bare_answer(c: Column) -> Column:
    """Without thinking blocks and code fences."""
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(c, r"```[A-Za-z]*", ""))


def answer_items(df: DataFrame, column: str) -> DataFrame:
    """Df with ``items`` (strings of the outermost JSON array, else the lines without list marks) and ``parsed``."""
    bare = bare_answer(F.col(column))
    outer = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    listed = F.from_json(outer, "array<string>")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", ""))), lambda x: x != "")
    return df.withColumn("parsed", listed.isNotNull()).withColumn("items", F.coalesce(F.when(outer != "", listed), lines))


def extraction_records(df: DataFrame, column: str) -> DataFrame:
    """One row a record with ``fields``, of delimited extraction text; other columns stay."""
    body = F.regexp_extract(F.col("record"), r"(?s)\((.*)\)", 1)
    cleaned = F.transform(F.split(body, r"<\|>"), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", ""))
    each = df.withColumn("record", F.explode(F.split(F.col(column), r"##|<\|COMPLETE\|>")))
    return each.withColumn("fields", cleaned).where(body != "").drop("record", column)


def extracted_nodes(records: DataFrame) -> DataFrame:
    """Name, type, description of entity records."""
    f = F.col("fields")
    return records.where((F.size(f) >= 4) & (F.get(f, F.lit(0)) == "entity") & (F.get(f, F.lit(1)) != "")).withColumn("name", F.get(f, F.lit(1))).withColumn("type", F.lower(F.get(f, F.lit(2)))).withColumn("description", F.get(f, F.lit(3))).drop("fields")


def extracted_edges(records: DataFrame) -> DataFrame:
    """Src, dst, description, keywords, weight of relationship records; self-loops and empty ends go."""
    f = F.col("fields")
    last = F.get(f, F.size(f) - 1)
    weight = F.coalesce(F.when(last.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), last.cast("double")), F.lit(1.0))
    out = records.where((F.size(f) >= 5) & (F.get(f, F.lit(0)) == "relationship")).withColumn("src", F.get(f, F.lit(1))).withColumn("dst", F.get(f, F.lit(2)))
    out = out.withColumn("description", F.get(f, F.lit(3))).withColumn("keywords", F.replace(F.get(f, F.lit(4)), F.lit("，"), F.lit(","))).withColumn("weight", weight)
    return out.where("src <> '' and dst <> '' and src <> dst").drop("fields")


def schema_map(rows: DataFrame) -> DataFrame:
    """Of (type, subtype, attrs, position) one row with type -> subtype -> attrs; the later duplicate wins.

    A schema is a short list; its size is that of the types, not of the data.
    """
    last = rows.groupBy("type", "subtype").agg(F.max_by("attrs", "position").alias("attrs"))
    per = last.groupBy("type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subtype", "attrs")))).alias("subtypes"))
    return per.groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", F.to_json("subtypes").alias("s"))))).alias("schema"))
