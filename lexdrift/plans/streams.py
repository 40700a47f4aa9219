"""Streaming queries, run over what is there, against the same counts in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.plans.common import table
from lexdrift.streaming import ingest


def stream_token_windows(spark, d):
    batch = table(spark, d, "dark_texts").select("line_id", "forum", "posted_at", "texts")
    stream = ingest.posts(spark, f"{d}/dark_texts.parquet", table(spark, d, "dark_texts")).where("posted_at is not null and forum is not null").select(*batch.columns)
    counts = ingest.run_available(ingest.windowed_tokens(ingest.deduplicated(stream, "line_id", "posted_at", "4000 days"), "posted_at", "texts"))
    return counts.select(F.unix_micros("start").alias("start"), "forum", "posts", "tokens")


QUERIES = [stream_token_windows]
ORACLES = {
    "stream_token_windows": r"""SELECT epoch_us(posted_at) - epoch_us(posted_at) % 604800000000 AS start, forum, count(*) AS posts, CAST(sum(len(regexp_extract_all(coalesce(texts, ''), '\S+'))) AS BIGINT) AS tokens
FROM dark_texts WHERE posted_at IS NOT NULL AND forum IS NOT NULL GROUP BY 1, 2""",
}
