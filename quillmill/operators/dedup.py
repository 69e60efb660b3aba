"""Keyed dedup, merges and set differences with a defined winner: never dropDuplicates, whose choice is arbitrary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in an order; rows with a null key part form groups like others."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_by_hash(df: DataFrame, text: str, order: list) -> DataFrame:
    """The first row of each text, by its MD5."""
    return first_by(df.withColumn("__h", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), ["__h"], order).drop("__h")


def unless_empty(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key; rows with a null or empty key all stay."""
    filled = F.coalesce(F.col(key), F.lit("")) != ""
    return first_by(df.where(filled), [key], order).unionByName(df.where(~filled))


def weight_replace(base: DataFrame, extra: DataFrame, key: str, order: list) -> DataFrame:
    """base and extra in one: extra wins a key, with the larger weight of all its rows; a flag says where a row came from."""
    both = base.withColumn("from_extra", F.lit(False)).unionByName(extra.withColumn("from_extra", F.lit(True)))
    top = both.withColumn("weight", F.max("weight").over(Window.partitionBy(key)))
    return first_by(top, [key], [F.desc("from_extra"), *order])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing, added or modified."""
    j = old.select(key, F.col(value).alias("__o"), F.lit(1).alias("__a")).join(new.select(key, F.col(value).alias("__n"), F.lit(1).alias("__b")), key, "full")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added").when(~F.col("__o").eqNullSafe(F.col("__n")), "modified")
    return j.select(key, state.alias("state")).where("state IS NOT NULL")


def upsert(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """table with rows put in by key: the highest version of each key stays."""
    return first_by(table.unionByName(rows), [key], [F.desc(version)])


def evidence_merge(df: DataFrame, key: list[str], order: Column, fill: list[str], tools: str, evidence: str) -> DataFrame:
    """One row per key: first known value of each field in the order, all tools, all evidence in order."""
    w = Window.partitionBy(*key).orderBy(order)
    placed = df.withColumn("__rn", F.row_number().over(w))
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__rn"))).alias(c) for c in fill]
    return placed.groupBy(*key).agg(*firsts, F.array_join(F.array_sort(F.collect_set(tools)), "+").alias(tools), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", evidence))), lambda x: x[evidence]), " | ").alias(evidence))
