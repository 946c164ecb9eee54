"""A keyed table for streams: each batch adds a run of changed keys, runs are merged in tiers, reads take the last of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.jobs import sized

FAN = 8  # runs of a tier that are merged into one of the next
BUCKETS = 64


class Deltas:
    """Rows by key in runs, each a Parquet folder by bucket of the key. A run holds all rows of the keys that its batches
    changed, or a mark that a key is gone.

    A batch writes its own changes and, once FAN runs of a tier are there, merges them: so it writes in proportion to
    what changes, each row again once a tier, and a read meets FAN runs a tier at most, whatever the number of batches.
    Given keys, a read takes their buckets only. A run counts once its mark is there; a batch that is run again replaces
    its run and sees what came before it. Runs that were merged are deleted, so a reader that began before reads anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.key, self.buckets, self.fan = spark, path.rstrip("/"), key, buckets, fan
        self.columns = spark.createDataFrame([], schema).schema
        self.whole = T.StructType([*self.columns, T.StructField("_batch", T.LongType()), T.StructField("_gone", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """(tier, first, last batch) of the runs that hold the table, or what came before a batch."""
        path, fs = self._at("_done")
        found = [tuple(map(int, f.getPath().getName().split("_"))) for f in fs.listStatus(path)] if fs.exists(path) else []
        kept: list[tuple[int, int, int]] = []
        for tier, first, last in sorted(found, reverse=True):  # a merged run hides those that it was made of
            if (before is None or last < before) and not any(a <= first and last <= b for _, a, b in kept):
                kept.append((tier, first, last))
        return sorted(kept, key=lambda r: r[1])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _read(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.whole)
        return reduce(DataFrame.unionByName, (self.spark.read.schema(self.whole).parquet(f"{self.path}/{'_'.join(map(str, r))}") for r in runs))

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of each key the rows of its last batch."""
        last = rows.groupBy(self.key).agg(F.max("_batch").alias("_batch"))
        return rows.join(last, [self.key, "_batch"])

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table, or the rows of some keys, now or before a batch. Keys are not null."""
        rows = self._read(self.runs(before))
        if keys is not None:
            asked = keys.select(self.key).distinct()
            found = [r["_bucket"] for r in asked.select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col("_bucket").isin(found)).join(sized(asked), self.key, "left_semi")
        return self._last(rows).where("not _gone").select(*self.columns.names)

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        name = "_".join(map(str, run))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}")
        path, fs = self._at(f"_done/{name}")
        fs.create(path, True).close()

    def write(self, changed: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """All rows of changed keys, and the keys that are gone, as a batch."""
        rows = changed.select(*self.columns.names, F.lit(batch).cast("long").alias("_batch"), F.lit(False).alias("_gone"), self._bucket())
        if gone is not None:
            none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(f.name) for f in self.columns]
            rows = rows.unionByName(gone.select(self.key).distinct().select(*none, F.lit(batch).cast("long").alias("_batch"), F.lit(True).alias("_gone"), self._bucket()))
        self._write(rows, (0, batch, batch))
        self._merge(batch)

    def _merge(self, batch: int) -> None:
        """Merge full tiers of runs before the batch, which may be run again."""
        while True:
            live = self.runs(batch)
            by: dict[int, list] = {}
            for r in live:
                by.setdefault(r[0], []).append(r)
            full = [(tier, r[: self.fan]) for tier, r in sorted(by.items()) if len(r) >= self.fan]
            if not full:
                return
            tier, old = full[0]
            rows = self._last(self._read(old))
            if old[0] == live[0]:  # nothing older has rows that a mark must hide
                rows = rows.where("not _gone")
            self._write(rows.select(*self.whole.names), (tier + 1, old[0][1], old[-1][2]))
            for r in old:
                name = "_".join(map(str, r))
                mark, fs = self._at(f"_done/{name}")
                fs.delete(mark, False)
                fs.delete(self._at(name)[0], True)
