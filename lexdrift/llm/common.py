"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark: SparkSession, sf_dir: str, names: list[str], *columns: str | Column) -> DataFrame:
    """The named tables under one another, with ``tbl`` before the given columns."""
    out = None
    for n in names:
        part = table(spark, sf_dir, n).select(F.lit(n).alias("tbl"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def first_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` first rows of ``df`` by a hash of their keys, which does not depend on how the table is laid out.

    About twice as many are let through by a bound on the same hash, so that no task reads more than that however
    large the table is; ties of the hash go by the keys.
    """
    h = F.xxhash64(*keys)
    share = min(1.0, 2.0 * rows / max(1, df.count()))
    return df.where((h / F.lit(2.0**64) + 0.5) <= share).orderBy(h, *keys).limit(rows)
