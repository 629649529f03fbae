"""Consecutive numbers in the order of a key, without a window over all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: str, bucket: Column, order: list, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in its group by `order`.

    bucket must not fall as the order rises: rows are sorted within (group, bucket), and buckets, of which a group has few,
    are counted and summed up. So a group is spread over as many tasks as it has buckets.
    """
    split = df.withColumn("__bucket", bucket)
    within = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    sums = sums.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = split.withColumn(name, within).join(sums, [group, "__bucket"])
    return placed.select(*df.columns, (F.col(name) + F.col("__base")).cast("long").alias(name))


def hash_bucket(hash_: Column) -> Column:
    """Three hex digits of a hash: 4096 buckets of equal size, in the order of the hashes."""
    return F.substring(hash_, 1, 3)


def arrival_bucket(arrival: Column) -> Column:
    """65,536 arrivals."""
    return F.shiftright(arrival.cast("long"), 16)
