import pytest
from pyspark.sql import functions as F

from kbspark import jobs
from kbspark.operators import graph, joins, ranking


@pytest.mark.parametrize("few", [64, 5, 0])
def test_small_sources_are_compared_without_intervals(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW", few, raising=False)
    rows = [(i % 7 if i % 13 else None, i, i * 5 % 31, i * 5 % 31 + i % 6 - 1) for i in range(40)]
    new = spark.createDataFrame(rows, "source_id long, new_id long, start long, end long")
    found = joins.overlapping(new, new.withColumnRenamed("new_id", "old_id"))
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and b[3] > a[2] and b[2] < a[3]}
    got = [tuple(r) for r in found.select("source_id", "new_id", "old_id").collect()]
    assert len(got) == len(want) > 20 and set(got) == want
    if few == 64:
        assert "Generate" not in found._jdf.queryExecution().toString()


def test_mentions_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(jobs, "TASK_ROWS", 100, raising=False)
    t = spark.range(3000).select((F.col("id") % 500).alias("src"), F.lit("r").alias("relation"), F.col("id").alias("dst"))
    out = graph.count_mentions(t.withColumn("mentions", F.lit(2).cast("long")), t)
    assert out.rdd.getNumPartitions() >= 60
    assert out.agg(F.count("*"), F.min("mentions"), F.max("mentions")).first() == (3000, 3, 3)


def test_owners_give_no_rows_beyond_what_any_can_use(spark):
    owned = spark.range(2000).select((F.col("id") % 3).alias("query_id"), (F.col("id") % 4).cast("int").alias("owner_rank"), F.col("id").alias("chunk_rank"), "id")
    out = ranking.poll_weighted(owned, 5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert {r["n"] for r in out.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {5 + 4 + 2 + 1}
