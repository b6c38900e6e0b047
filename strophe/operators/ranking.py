"""Dense global ordinals and top-k without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.sources.workspace import materialize


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt over ranges of ``order``, with _range and _place, the place inside of it."""
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return dealt.withColumns({"_range": F.spark_partition_id(), "_place": place}).drop("_salt")


def with_ordinal(df: DataFrame, name: str, *order: Column, first: int = 0) -> DataFrame:
    """``df`` and its dense place by ``order``; rows that are equal in it get places in any order.

    Rows are dealt over ranges of the whole order, with their own place in the table as the last key, so
    that not even equal rows must share a range. The ranges are written, numbered inside, and the counts
    of the ranges, a row for each partition, give each one its offset.
    """
    placed = materialize(ranged(df, *order), "ordinals")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_range")  # a row for each partition
    return numbered.withColumn(name, (F.col("_before") + F.col("_place") + first).cast("long")).drop("_range", "_place", "_before")


def top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """The first ``k`` rows in order; 0, negative or none means all of them, in order."""
    ordered = df.orderBy(*order)
    return ordered.limit(k) if k and k > 0 else ordered


def best_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_best", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_best = 1").drop("_best")
