"""Table generation: periods, typed columns, guarded SQL, rendering."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORBIDDEN = re.compile(r"\b(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b", re.IGNORECASE)


def guarded_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run a query that begins with SELECT and holds none of the changing words (as whole words, outside quotes)."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if not re.match(r"\s*SELECT\b", bare, re.IGNORECASE) or _FORBIDDEN.search(bare):
        raise ValueError("only SELECT is allowed")
    return spark.sql(text)


def declared_schema(columns: list[tuple[str, str, str]]) -> T.StructType:
    """(name, description, number or other) as a schema; descriptions are comments."""
    kinds = {"number": T.DecimalType(28, 6)}
    return T.StructType([T.StructField(re.sub(r"[^0-9A-Za-z_一-鿿]", "_", n.strip()) or "_", kinds.get(k, T.StringType()), True, {"comment": d}) for n, d, k in columns])


def table_text(name: str, schema: T.StructType) -> str:
    """The text that makes such a table, with its comments."""
    quoted = lambda x: x.replace("'", "''")
    lines = [f"  `{f.name}` {f.dataType.simpleString().upper()} COMMENT '{quoted(f.metadata.get('comment', ''))}'" for f in schema]
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(lines) + "\n)"


def years(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Position, value of the years start..end."""
    return spark.range(start, end + 1).select((F.col("id") - start).alias("position"), F.col("id").cast("string").alias("value"))


def quarters(spark: SparkSession, start: tuple[int, int | None], end: tuple[int, int | None]) -> DataFrame:
    """``YYYY Qn``; a missing quarter is the first at the start and the last at the end."""
    a, b = start[0] * 4 + (start[1] or 1) - 1, end[0] * 4 + (end[1] or 4) - 1
    return spark.range(a, b + 1).select((F.col("id") - a).alias("position"), F.concat_ws(" Q", F.floor(F.col("id") / 4), F.col("id") % 4 + 1).alias("value"))


def questions(grid: DataFrame) -> DataFrame:
    """Q6: a default question a task."""
    return grid.withColumn("query", F.concat_ws(" ", "entity", "time", "metric"))


def report(contexts: DataFrame) -> DataFrame:
    """P20: query_id, prompt: numbered contexts(query_id, rank, text) in order."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    return contexts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))
