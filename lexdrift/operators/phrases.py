"""Phrase detection: bigram and unigram counts, scores, greedy merge; co-occurrence counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.operators.order import in_parts
from lexdrift.session import stage


def unigrams(lines: DataFrame) -> DataFrame:
    """``(word, n)`` of ``lines(line_id, tokens)``."""
    return lines.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bigrams(lines: DataFrame, cross_line: bool = True) -> DataFrame:
    """``(a, b, n)``: neighbouring words. With ``cross_line`` the last word of a line and the first of the next non-empty line count too.

    Within lines this needs no shuffle before the count. The borders are one row per line, put in order by
    a sort by ranges, where each partition's last word is carried over.
    """
    inside = lines.select(F.explode(F.expr("zip_with(slice(tokens, 1, greatest(size(tokens) - 1, 0)), slice(tokens, 2, size(tokens)), (a, b) -> struct(a, b))")).alias("p")).select("p.a", "p.b")
    if cross_line:
        inside = inside.union(_borders(lines))
    return inside.groupBy("a", "b").agg(F.count("*").alias("n"))


def _borders(lines: DataFrame) -> DataFrame:
    ends = in_parts(lines.where(F.size("tokens") > 0).select("line_id", F.element_at("tokens", 1).alias("first"), F.element_at("tokens", -1).alias("last")), F.col("line_id"))
    within = ends.withColumn("a", F.lag("last").over(Window.partitionBy("part").orderBy("line_id")))
    # one row per partition: its last word, carried to the next partition that has rows
    tails = ends.groupBy("part").agg(F.max_by("last", "line_id").alias("last"))
    carried = tails.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "before")
    heads = within.where("a is null").join(carried, "part").where("before is not null").select(F.col("before").alias("a"), F.col("first").alias("b"))
    return within.where("a is not null").select("a", F.col("first").alias("b")).union(heads)


def scores(lines: DataFrame, min_count: int = 5, cross_line: bool = True) -> DataFrame:
    """``(a, b, n, score)`` with score (n - min) / (count a) / (count b) * words, of words of at least ``min_count``."""
    uni = stage(unigrams(lines), "unigrams")
    words = uni.agg(F.sum("n").alias("words"))
    frequent = uni.where(F.col("n") >= min_count)
    pairs = bigrams(lines, cross_line)
    return (
        pairs.join(frequent.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(frequent.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
        .crossJoin(F.broadcast(words))  # one row
        .select("a", "b", "n", ((F.col("n") - min_count) / F.col("na") / F.col("nb") * F.col("words")).alias("score"))
    )


def merge(lines: DataFrame, scored: DataFrame, threshold: float = 100.0) -> DataFrame:
    """``(line_id, line)``: words of pairs above the threshold joined by ``_``, left to right; after a merge the next word cannot merge.

    In a run of positions that qualify, the odd ones merge. Pairs never merge across lines. The positions
    of a line are one group; lines, not words, are the unit of the windows.
    """
    good = scored.where(F.col("score") > threshold).select("a", "b")
    words = lines.where(F.size("tokens") > 0).select("line_id", "tokens", F.posexplode("tokens").alias("pos", "b")).withColumn("a", F.expr("get(tokens, pos - 1)")).drop("tokens")
    hit = words.join(good.withColumn("hit", F.lit(1)), ["a", "b"], "left")
    w = Window.partitionBy("line_id").orderBy("pos")
    runs = hit.withColumn("miss", F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).over(w))
    at = runs.withColumn("nth", F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("line_id", "miss").orderBy("pos")))
    glue = F.when(F.col("pos") == 0, "").when(F.col("hit").isNotNull() & (F.col("nth") % 2 == 1), "_").otherwise(" ")
    piece = at.select("line_id", "pos", F.concat(glue, "b").alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return piece.groupBy("line_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("line"))


def cooccurrences(lines: DataFrame, vocab: DataFrame, window: int = 5, chunk: int = 1000) -> DataFrame:
    """``(center, context, n)``: words of the vocabulary within ``window`` places, foreign words taken out first.

    Lines are cut to ``chunk`` known words. The neighbours come from the line's own array, without a self
    join; frequent pairs are counted before the shuffle.
    """
    known = lines.select("line_id", F.posexplode("tokens").alias("pos", "word")).join(vocab.select("word"), "word")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    kept = known.groupBy("line_id").agg(ordered.alias("t"))
    parts = kept.select(F.explode(F.expr(f"transform(sequence(0, cast((size(t) - 1) div {chunk} as int)), k -> slice(t, k * {chunk} + 1, {chunk}))")).alias("t"))
    pairs = parts.select("t", F.posexplode("t").alias("i", "center")).select(
        "center", F.explode(F.expr(f"filter(transform(filter(sequence(-{window}, {window}), o -> o <> 0), o -> get(t, i + o)), x -> x is not null)")).alias("context")
    )
    return pairs.groupBy("center", "context").agg(F.count("*").alias("n"))
