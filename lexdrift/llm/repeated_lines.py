"""Lines repeated across the documents of one source, and documents without them.

Each line is reduced to its letters (Unicode category L), lower-cased, and hashed; a row adds each of
its hashes once, so counts are numbers of rows. Counting is partial before the shuffle, so a line that
stands in a third of all rows arrives as one number per task.

The frequent lines of a source are few: if its rows have m distinct lines on average, at most m / min_share
lines stand in min_share of them. Over all sources they can still be many, so they are counted first: up to
``SENT_AT_MOST`` are sent to every task, and the texts are not shuffled; beyond that lines and frequent lines
meet by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.session import stage

MIN_ROWS, MIN_SHARE, SENT_AT_MOST = 4, 0.02, 500_000  # the last is 16 bytes a line, 8 MB


def line_hash(line: Column) -> Column:
    """64-bit hash of the line's letters in lower case; null for a line without letters."""
    letters = F.lower(F.regexp_replace(line, r"\P{L}+", ""))
    return F.when(letters != "", F.xxhash64(letters))


def _hashes(df: DataFrame, source: str, key: str, comments: str) -> DataFrame:
    return df.select(
        F.col(source).alias("tbl"),
        F.col(key).alias("row_id"),
        F.transform(F.col(comments), lambda c: F.transform(F.split(c, "\n"), line_hash)).alias("hashes"),
    )


def frequent_lines(
    df: DataFrame, source: str = "tbl", key: str = "row_id", comments: str = "comments",
    min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``(tbl, h, n)``: hashes of lines in at least ``min_rows`` rows and ``min_share`` of all rows of the source.

    Null comments and null lists hold no lines but their rows count as rows. A repeated row counts as
    often as it occurs. An empty table has no frequent lines. Rows with a null source are a source of
    their own.
    """
    flat = F.flatten(F.filter("hashes", lambda a: a.isNotNull()))
    counts = (
        _hashes(df, source, key, comments)
        .select("tbl", F.explode(F.array_distinct(flat)).alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy("tbl", "h")
        .agg(F.count("*").alias("n"))
    )
    totals = df.groupBy(F.col(source).alias("t")).agg(F.count("*").alias("rows"))
    # a row per source on the right; sent to every task only if it is small
    return (
        counts.where(F.col("n") >= min_rows).join(totals, F.expr("tbl <=> t"))
        .where(F.col("n") >= F.lit(min_share) * F.col("rows"))
        .select("tbl", "h", "n")
    )


def _staged(df: DataFrame, source: str, key: str, comments: str, sent_at_most: int, **limits) -> tuple[DataFrame, bool]:
    """The frequent lines ``(t, fh)`` as a table, and whether they are few enough to be sent to every task."""
    frequent = stage(frequent_lines(df, source, key, comments, **limits).select(F.col("tbl").alias("t"), F.col("h").alias("fh")), "frequent")
    return frequent, frequent.count() <= sent_at_most


def repeated_line_occurrences(
    df: DataFrame, source: str = "tbl", key: str = "row_id", comments: str = "comments", sent_at_most: int = SENT_AT_MOST, **limits,
) -> DataFrame:
    """``(tbl, row_id, comment_ix, line_no)``: every occurrence of a frequent line, places from 0.

    Same treatment of nulls, empty texts and repeated rows as ``frequent_lines``; a very long comment
    is split into lines like any other.
    """
    frequent, few = _staged(df, source, key, comments, sent_at_most, **limits)
    return (
        _hashes(df, source, key, comments)
        .select("tbl", "row_id", F.posexplode("hashes").alias("comment_ix", "lines"))
        .select("tbl", "row_id", "comment_ix", F.posexplode("lines").alias("line_no", "h"))
        .where(F.col("h").isNotNull())
        .join(F.broadcast(frequent) if few else frequent.hint("merge"), F.expr("h = fh and tbl <=> t"), "left_semi")
        .select("tbl", "row_id", F.col("comment_ix").cast("bigint"), F.col("line_no").cast("bigint"))
    )


def without_repeated_lines(
    df: DataFrame, source: str = "tbl", key: str = "row_id", comments: str = "comments", sent_at_most: int = SENT_AT_MOST, **limits,
) -> DataFrame:
    """``(tbl, row_id, comments)``: the rows with the frequent lines taken out of each comment.

    One row per input row. A null comment stays null, a comment of only frequent lines becomes empty.
    """
    frequent, few = _staged(df, source, key, comments, sent_at_most, **limits)
    rows = df.select(F.col(source).alias("tbl"), F.col(key).alias("row_id"), F.col(comments).alias("comments"))
    if few:
        lists = F.broadcast(frequent.groupBy("t").agg(F.collect_list("fh").alias("listed")))  # at most ``sent_at_most`` numbers
        marked = rows.join(lists, F.expr("tbl <=> t"), "left")
    else:
        # what a row has of them is found by the hash and brought back to it; only numbers are shuffled before the join of the rows
        rows = rows.withColumn("uid", F.struct("tbl", "row_id", F.xxhash64("comments").alias("said")))
        each = rows.select(
            "uid", "tbl", F.explode(F.array_distinct(F.flatten(F.filter(F.transform("comments", lambda c: F.transform(F.split(c, "\n"), line_hash)), lambda a: a.isNotNull())))).alias("h")
        )
        of = each.where("h is not null").join(frequent.hint("merge"), F.expr("h = fh and tbl <=> t"), "left_semi").groupBy("uid").agg(F.collect_set("h").alias("listed")).withColumnRenamed("uid", "u")
        marked = rows.join(of, F.expr("uid <=> u"), "left")
    # of the listed lines those that the row has, worked out once a row: its lines are then compared with these few only
    had = F.flatten(F.transform(F.filter("comments", lambda c: c.isNotNull()), lambda c: F.transform(F.split(c, "\n"), line_hash)))
    own = F.array_intersect(had, F.coalesce("listed", F.array().cast("array<bigint>")))
    without = lambda c, o: F.array_join(F.filter(F.split(c, "\n"), lambda s: ~F.coalesce(F.array_contains(o, line_hash(s)), F.lit(False))), "\n")
    # bound as the one element of an array, else it is worked out again for every line
    kept = F.get(F.transform(F.array(own), lambda o: F.transform(F.col("comments"), lambda c: F.when(F.size(o) > 0, without(c, o)).otherwise(c))), F.lit(0))
    return marked.select("tbl", "row_id", F.when(F.col("comments").isNotNull(), kept).alias("comments"))
