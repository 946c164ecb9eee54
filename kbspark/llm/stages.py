"""What the operators of this subpackage take from the library: lineage cuts, checked broadcasts, components; and rows by their texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.jobs import components, partitions, release, settle, shared_dir, sized, spread_join

__all__ = ["by_text", "components", "partitions", "release", "settle", "shared_dir", "sized", "spread_join"]


def by_text(docs: DataFrame) -> DataFrame:
    """doc_id, text, row of every row of docs: where an id has several texts, each gets an id of its own, above 2**62, from
    id and text, so that none is taken for another. row: all columns of docs as a struct, whatever their names."""
    t = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    varied = texts.groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("doc_id is not null and low <> high").select("doc_id", F.lit(True).alias("varied"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("row")).join(sized(settle(varied, "varied-ids")), "doc_id", "left")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    return rows.select(F.when(F.col("varied"), own).otherwise(F.col("doc_id")).alias("doc_id"), "text", "row")
