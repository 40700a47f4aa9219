"""Threads: assembly from posts, joins with titles and users, upsert, search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.functions.text import deaccent, word_tokens


def posts_with_users(posts: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Every post, with its author's name where the user is known."""
    return posts.join(users, key, "left")


def assemble(posts: DataFrame, thread: str = "thread_id") -> DataFrame:
    """``(thread, comments, authors, first_ts, last_ts)`` from ``posts(thread, seq, author, body[, ts])``.

    Comments in the order of (seq, body), null bodies as empty texts; distinct authors in lower case,
    null and empty ones left out. Threads with a null key are dropped. A thread is one row, so its
    comments meet in one task by nature of the result.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("body", F.lit("")).alias("body"))))
    author = F.when(F.col("author") != "", F.lower("author"))
    extra = [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")] if "ts" in posts.columns else []
    return posts.where(F.col(thread).isNotNull()).groupBy(thread).agg(F.transform(ordered, lambda p: p["body"]).alias("comments"), F.sort_array(F.collect_set(author)).alias("authors"), *extra)


def with_titles(threads: DataFrame, titles: DataFrame, key: str = "thread_id", keep_untitled: bool = True, keep_title_only: bool = True) -> DataFrame:
    """Threads joined with their titles; title-only threads are kept unless told otherwise."""
    how = {(True, True): "full", (True, False): "left", (False, True): "right", (False, False): "inner"}[keep_untitled, keep_title_only]
    return threads.join(titles, key, how)


def upsert(df: DataFrame, key: str, *latest: Column) -> DataFrame:
    """The last row of every key in the order of ``latest``; rows without a key are dropped."""
    w = Window.partitionBy(key).orderBy(*(c.desc() for c in latest))
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inverted_index(threads: DataFrame, key: str = "row_id") -> DataFrame:
    """``(token, key, comment_ix)``: the distinct tokens of each comment, to be written bucketed by token."""
    c = threads.select(key, F.posexplode("comments").alias("comment_ix", "c"))
    return c.select(F.explode(F.array_distinct(word_tokens(deaccent(F.lower("c"))))).alias("token"), key, "comment_ix")


def search_lines(threads: DataFrame, words: DataFrame, key: str = "row_id") -> DataFrame:
    """``(word, forum, line)``: distinct lines that hold one of the words as a token.

    Lines are cut to tokens once and joined with the words on equality, so any number of words is one join.
    """
    lines = threads.select("forum", F.explode("comments").alias("c")).select("forum", F.explode(F.split("c", "\n")).alias("line"))
    tokens = lines.select("forum", "line", F.explode(F.array_distinct(word_tokens(deaccent(F.lower("line"))))).alias("word"))
    return tokens.join(words.select("word").distinct(), "word").select("word", "forum", "line").distinct()
