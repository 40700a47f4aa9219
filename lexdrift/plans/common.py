"""Tables and views of the test data, for the queries and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DARK, WHITE = ["nulled", "hackforums", "darkode"], ["reddit"]
FORUMS = ["nulled", "hackforums", "darkode", "silkroad_fts", "reddit"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def threads(spark: SparkSession, d: str, names: list[str], *columns) -> DataFrame:
    parts = [table(spark, d, n).select(F.lit(n).alias("forum"), *columns) for n in names]
    return reduce(DataFrame.unionByName, parts)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(model, word, idx, vector)``: one row per word of a model, finite vectors of 64 numbers, not all zero."""
    v = F.col("vector")
    good = (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table(spark, d, "syn0").where(good).dropDuplicates(["model", "idx"]).select("model", "word", "idx", F.col("vector").cast("array<double>").alias("vector"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """``(word, cn, gcn, bcn)``: the partial counts of all shards added up."""
    return (
        table(spark, d, "goodbad_vocab").where("word is not null").groupBy("word")
        .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cn", "gcn", "bcn")))
    )


# The same in SQL, as common table expressions.
SQL_VECTORS = """vectors AS (
  SELECT DISTINCT ON (model, idx) model, word, idx, CAST(vector AS DOUBLE[]) AS vector FROM syn0
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
)"""
SQL_COUNTS = """word_counts AS (
  SELECT word, CAST(coalesce(sum(cn), 0) AS BIGINT) AS cn, CAST(coalesce(sum(gcn), 0) AS BIGINT) AS gcn, CAST(coalesce(sum(bcn), 0) AS BIGINT) AS bcn
  FROM goodbad_vocab WHERE word IS NOT NULL GROUP BY word
)"""
