"""Candidates of changed meaning, their explanations, annotations and labels; dated tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.functions.text import span, word_tokens
from lexdrift.operators import vectors as X
from lexdrift.operators.order import numbered
from lexdrift.operators.threads import search_lines


def candidates(vectors: DataFrame, counts: DataFrame, least_good: int = 100, least_bad: int = 50, ceiling: float = 0.3) -> DataFrame:
    """``(rank, word, idx, sim, gcn, bcn)``: frequent words whose two vectors differ most, ranked by rising similarity.

    Similarities are rounded to six digits, ties go to the lower number.
    """
    sims = X.cross_model(vectors).select("word", "idx", F.round("sim", 6).alias("sim")).where(F.col("sim") < ceiling)
    few = sims.join(counts, "word").where((F.col("gcn") >= least_good) & (F.col("bcn") >= least_bad))
    return numbered(few, "rank", F.col("sim"), F.col("idx"), start=1).select("rank", "word", "idx", "sim", "gcn", "bcn")


def explained(cands: DataFrame, vectors: DataFrame, counts: DataFrame, k: int = 100, least: int = 10, against: str = "good") -> DataFrame:
    """Candidates with three lists of near words: of the bad vector by good and by bad count, and of the good vector.

    The bad vector is compared with the good model's words, as the output is defined; ``against="bad"``
    compares the second list with the bad model instead.
    """
    good, bad = X.unit_rows(vectors, "good"), X.unit_rows(vectors, "bad")
    words = vectors.where("model = 'good'").select("idx", "word")
    none = F.array().cast("array<bigint>").alias("skip")
    of_bad = cands.join(bad, "idx").select(F.col("idx").alias("qid"), "vec", none)
    of_good = cands.join(good, "idx").select(F.col("idx").alias("qid"), "vec", none)
    near_bad = X.top_products(of_bad, good, k)
    lists = {
        "good_interpretation": (near_bad, F.col("gcn")),
        "bad_interpretation": (near_bad if against == "good" else X.top_products(of_bad, bad, k), F.col("bcn")),
        "normal_interpretation": (X.top_products(of_good, good, k), F.col("gcn")),
    }
    out = cands
    for name, (top, count) in lists.items():
        named = top.join(words, "idx").join(counts, "word").where(count >= least)
        listed = named.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias(name))
        out = out.join(listed.withColumnRenamed("qid", "idx"), "idx", "left")
    return out


def annotation_tokens(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """``(token, forum, type, tagger)``: distinct tokens of more than one character in the annotated spans.

    ``spans(forum, code, start, end_pos, tagger)``, ``texts(forum, code, type, text)``; joined on forum and code.
    """
    words = spans.join(texts, ["forum", "code"]).select("forum", "type", "tagger", F.explode(word_tokens(span(F.col("text"), F.col("start"), F.col("end_pos")))).alias("token"))
    return words.where(F.length("token") > 1).select("token", "forum", "type", "tagger").distinct()


def labels(tokens: DataFrame) -> DataFrame:
    """``(token, label)``: distinct forums and distinct types, each joined by a slash."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.coalesce(c, F.lit("None")))), "/")
    return tokens.groupBy("token").agg(F.concat_ws(" ", joined("forum"), joined("type")).alias("label"))


def labelled(cands: DataFrame, marks: DataFrame) -> DataFrame:
    """Candidates with ``labeled`` and their ``label``, empty without one."""
    return cands.join(marks.withColumnRenamed("token", "word"), "word", "left").select("rank", "word", "sim", F.col("label").isNotNull().alias("labeled"), F.coalesce("label", F.lit("")).alias("label"))


def missed(cands: DataFrame, marks: DataFrame, vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """Annotated tokens that are no candidates, with their similarity and counts where known; sample sentences are null."""
    sims = X.cross_model(vectors).select("word", F.round("sim", 6).alias("sim"))
    rest = marks.withColumnRenamed("token", "word").join(cands.select("word"), "word", "left_anti")
    return rest.join(sims, "word", "left").join(counts, "word", "left").select("word", "sim", "gcn", "bcn", F.lit(None).cast("string").alias("bad_sen"), F.lit(None).cast("string").alias("good_sen"), "label")


def sample_lines(words: DataFrame, threads: DataFrame, name: str) -> DataFrame:
    """``(word, name)``: the lines of ``threads(forum, comments)`` that hold the word, each after its forum, in order, joined by dots."""
    lines = search_lines(threads, words).select("word", F.concat(F.lit("["), "forum", F.lit("] "), "line").alias("line"))
    return lines.groupBy("word").agg(F.array_join(F.sort_array(F.collect_set("line")), "...... ").alias(name))


def with_samples(cands: DataFrame, dark: DataFrame, white: DataFrame) -> DataFrame:
    """Candidates with ``bad_sen`` and ``good_sen``, their lines in the dark and in the white threads, empty without one."""
    words = cands.select("word")
    out = cands.join(sample_lines(words, dark, "bad_sen"), "word", "left").join(sample_lines(words, white, "good_sen"), "word", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("bad_sen", "good_sen")})


def missed_explained(cands: DataFrame, marks: DataFrame, vectors: DataFrame, counts: DataFrame, k: int = 100, least: int = 10) -> DataFrame:
    """The rows of ``missed`` with the three lists of near words of ``explained``, null for words without vectors."""
    words = vectors.where("model = 'good'").select("word", "idx")
    return explained(missed(cands, marks, vectors, counts).join(words, "word", "left"), vectors, counts, k, least)


def panels(report: DataFrame) -> DataFrame:
    """``(measure, word, x, y)``: the points of three panels of ``report(word, good_occurrence, bhattacharyya, cosine)``, without those that are not finite."""
    finite = lambda *cs: " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in cs)
    point = lambda name, x, y, *need: report.where(finite(*need)).select(F.lit(name).alias("measure"), "word", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    first = point("bhattacharyya", "bhattacharyya", "good_occurrence", "bhattacharyya", "cosine")
    return first.union(point("cosine", "cosine", "good_occurrence", "cosine")).union(point("both", "cosine", "bhattacharyya", "bhattacharyya", "cosine"))


def dated_tokens(tokens: DataFrame, dates: DataFrame, more_than: int = 3) -> DataFrame:
    """``(token, thread, start_date, end_date)``: tokens of threads of more than ``more_than`` distinct tokens, with the thread's dates.

    ``tokens(thread, token)``, ``dates(thread, ts)``. Undated threads are dropped.
    """
    once = tokens.distinct()
    rich = once.groupBy("thread").count().where(F.col("count") > more_than).select("thread")
    ranges = dates.where("ts is not null").groupBy("thread").agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))
    return once.join(ranges.join(rich, "thread", "left_semi"), "thread").select("token", "thread", "start_date", "end_date")


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """``(measure, mean, max, min, median, std)`` of the columns; population deviation, exact median."""
    parts = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns))
    long = df.select(F.explode(parts).alias("m")).select("m.measure", "m.x").where("x is not null and not isnan(x)")
    return long.groupBy("measure").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.median("x").alias("median"), F.stddev_pop("x").alias("std"))


def rank_correlation(lists: DataFrame, a: str, b: str) -> DataFrame:
    """``(qid, correlation, pvalue)``: Spearman's rho of two equally long index lists, place by place.

    As defined, it correlates the indexes that stand at the same place, not their scores. The p-value is
    two-sided from Student's t with n - 2 degrees of freedom.
    """
    long = lists.select("qid", F.posexplode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))).alias("pos", "p")).select("qid", "p.x", "p.y").where("x is not null and y is not null")
    ranked = long.withColumn("rx", F.rank().over(Window.partitionBy("qid").orderBy("x"))).withColumn("ry", F.rank().over(Window.partitionBy("qid").orderBy("y")))
    rho = ranked.groupBy("qid").agg(F.corr("rx", "ry").alias("correlation"), F.count("*").alias("n"))
    return rho.select("qid", "correlation", student_p("correlation", "n").alias("pvalue"))


def student_p(rho: str, n: str):
    """Two-sided p-value of a correlation, by the incomplete beta function."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_p_value(a, b) for a, b in zip(r, n)])

    return p(F.col(rho), F.col(n).cast("double"))


def _p_value(r: float, n: float) -> float | None:
    import math

    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return _beta(df / (df + t2), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 + top * d
        d = 1 / (d if abs(d) > 1e-30 else 1e-30)
        c = 1 + top / (c if abs(c) > 1e-30 else 1e-30)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)
