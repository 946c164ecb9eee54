"""Keyed changes of tables, each one join and a union (S8-S10, S14). Where they are written is the caller's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: list[str], order: str | None = None, created: str | None = None, updated: str | None = None) -> DataFrame:
    """Source rows replace those of their key; the last by ``order`` counts; ``created`` of an old row is kept
    where a source has none, ``updated`` is the source's."""
    if order:
        source = source.groupBy(*key).agg(F.max_by(F.struct(*source.columns), F.struct(order)).alias("_r")).select("_r.*")
    if created:
        old = target.select(*key, F.col(created).alias("_old"))
        source = source.join(old, key, "left").withColumn(created, F.coalesce("_old", created)).drop("_old")
    return target.join(source.select(*key).distinct(), key, "left_anti").unionByName(source.select(*target.columns))


def insert_absent(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Target and those source rows whose key it lacks; of repeated new keys the smallest row."""
    new = source.select(*target.columns).join(target.select(*key).distinct(), key, "left_anti")
    new = new.groupBy(*key).agg(F.min(F.struct(*target.columns)).alias("_r")).select("_r.*")
    return target.unionByName(new)


def delete_keys(target: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of rows deleted) for the keys, by their columns."""
    on = keys.columns
    keys = keys.distinct()
    return target.join(keys, on, "left_anti"), target.join(keys, on, "left_semi").agg(F.count("*").alias("deleted"))


def delete_where(target: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The same by a predicate; rows for which it is null stay."""
    hit = F.coalesce(condition, F.lit(False))
    return target.where(~hit), target.agg(F.count_if(hit).alias("deleted"))


def purge(table: DataFrame, **scope: str) -> DataFrame:
    """The table without one namespace, such as kb=..., dataset=... or a memory scope."""
    if not scope:
        raise ValueError("a namespace is needed")
    inside = F.lit(True)
    for name, value in scope.items():
        inside &= F.col(name).eqNullSafe(F.lit(value))
    return table.where(~inside)


def first_by(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
