"""Running numbers over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.session import stage


def in_parts(df: DataFrame, *order: Column) -> DataFrame:
    """The rows sorted by ranges, staged with the number of their range as ``part``: later steps see one sort only."""
    return stage(df.orderBy(*order).withColumn("part", F.spark_partition_id()), "ordered")


def numbered(df: DataFrame, name: str, *order: Column, start: int = 0) -> DataFrame:
    """The rows with their place in the order as ``name``: place within the range, after the rows of the ranges before."""
    parts = in_parts(df, *order)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # a row per range
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("at", place).join(before, "part").withColumn(name, (F.col("before") + F.col("at") - 1 + start).cast("bigint")).drop("part", "at", "before")
