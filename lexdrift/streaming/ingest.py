"""Streaming ingest of posts: deduplication within a watermark and windowed token counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.functions.text import blank_tokens
from lexdrift.session import shared_dir


def posts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files at a path, a file or a folder, with the schema of ``like``.

    The path is given as a pattern that only it matches, since the source takes a plain path for a folder.
    """
    return spark.readStream.schema(like.schema).parquet(f"{path[:-1]}[{path[-1]}]")


def deduplicated(stream: DataFrame, key: str, time: str, lateness: str = "30 days") -> DataFrame:
    """Posts whose key was not seen within the watermark; later repeats are let through only when the state is gone."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_tokens(stream: DataFrame, time: str, text: str, width: str = "7 days") -> DataFrame:
    """``(start, forum, posts, tokens)`` per window of event time and forum."""
    sized = stream.select(time, "forum", F.size(blank_tokens(F.coalesce(text, F.lit("")))).cast("bigint").alias("n"))
    return sized.groupBy(F.window(time, width).alias("w"), "forum").agg(F.count("*").alias("posts"), F.sum("n").alias("tokens")).select(F.col("w.start").alias("start"), "forum", "posts", "tokens")


def run_available(counts: DataFrame, keys: tuple[str, ...] = ("start", "forum"), name: str = "tokens") -> DataFrame:
    """Run a stream over what is there, and give the last counts of every key.

    The state of windows that the watermark has passed is dropped. Every batch writes the keys that changed in it
    to a table of its own in the shared folder, so a batch that is repeated after a failure leaves the same
    table; of a key the row of its last batch counts.
    """
    spark = counts.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/lexdrift-stream-{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not q.lastProgress:
        return spark.createDataFrame([], counts.schema)
    out = spark.read.parquet(f"{root}/out")
    last = out.groupBy(*keys).agg(*(F.max_by(c, "epoch").alias(c) for c in counts.columns if c not in keys))
    return last.select(*counts.columns)
