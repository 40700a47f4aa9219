"""The command surface as functions by name: each takes frames or paths and gives frames.

``run("coverage", ...)`` is the dispatcher; ``COMMANDS`` lists what there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.functions import vector as V
from lexdrift.operators import evaluation, models, parsing, phrases, training, vectors, vocabulary
from lexdrift.session import stage


def preprocess(pages: DataFrame, kind: str, key: str = "id", dated: bool = False) -> DataFrame:
    """Pages to threads with their cleaned token line; ``kind`` names a parser of the registry."""
    parsed = parsing.parse_pages(pages, kind, key, dated)
    return parsed.withColumn("texts", F.array_join(T.pure_tokens(F.col("title"), F.col("comments"), F.col("authors")), " "))


def gettime(threads: DataFrame) -> DataFrame:
    """``threads(thread, title, comments, dates)`` to tokens with the date ranges of their threads."""
    tokens = threads.select("thread", F.explode(F.flatten(F.flatten(F.filter(T.sentence_tokens(F.concat(F.array("title"), "comments")), lambda s: s.isNotNull())))).alias("token"))
    return evaluation.dated_tokens(tokens, threads.select("thread", F.explode("dates").alias("ts")))


def prepare(dark: DataFrame, white: DataFrame, frequent: int = 200) -> dict[str, DataFrame]:
    """``(forum, row_id, comments)`` of both sides to lines of sentences made of shared or frequent words."""
    sides = {}
    for name, rows in (("dark", dark), ("white", white)):
        s = T.sentence_tokens(F.col("comments"))
        sides[name] = stage(rows.select(F.struct("forum", "row_id").alias("thread"), F.posexplode(F.flatten(F.filter(s, lambda x: x.isNotNull()))).alias("at", "tokens")), f"sentences-{name}")
    counts = {n: s.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")) for n, s in sides.items()}
    allowed = stage(vocabulary.shared_or_frequent(counts["dark"], counts["white"], frequent), "allowed")
    return {n: vocabulary.aligned_lines(s, allowed).select("thread.forum", "thread.row_id", "line") for n, s in sides.items()}


def prepare_text2data(threads: DataFrame, least: int = 100) -> DataFrame:
    """Prose of threads of more than ``least`` characters."""
    return threads.withColumn("prose", T.prose(F.col("comments"))).where(F.length("prose") > least)


def text_stats(threads: DataFrame) -> DataFrame:
    return threads.select("forum", F.explode(T.blank_tokens(F.col("texts"))).alias("word")).groupBy("forum", "word").agg(F.count("*").alias("n"))


def coverage(vocab: DataFrame, frequent: int = 10) -> dict[str, DataFrame]:
    """``vocab(label, word, n)`` with labels ``dark`` and ``white``: summary, histogram, missed and common words."""
    often = vocab.where(F.col("n") > frequent)
    dark, white = often.where("label = 'dark'").select("word", "n"), often.where("label = 'white'").select("word")
    return {
        "summary": vocabulary.coverage_summary(vocab, frequent), "histogram": vocabulary.coverage_histogram(vocab, frequent),
        "missed": dark.join(white, "word", "left_anti"), "common": dark.join(white, "word", "left_semi"),
    }


def vocab(lines: DataFrame, min_count: int = 5, common_only: bool = False) -> DataFrame:
    """``lines(corpus, tokens)`` to the numbered two-corpus vocabulary."""
    counts = vocabulary.two_corpus_counts(lines.select("corpus", F.explode("tokens").alias("word")), lines.select("corpus"))
    return vocabulary.indexed(vocabulary.common(counts) if common_only else counts, min_count)


def train(lines: DataFrame, vocab: DataFrame, how: str = "cotrain", **options) -> DataFrame:
    """``lines(corpus, line_id, tokens)`` with corpora ``good`` and ``bad`` to vectors of two models.

    ``cotrain`` shares the output matrix, ``separate`` trains each corpus alone, ``single`` trains on all lines as ``good``.
    """
    vocab = stage(vocab, "vocab")
    number = F.when(F.col("corpus") == "bad", 0 if how == "single" else 1).otherwise(0).alias("corpus")
    encoded = stage(training.encode(lines.select(number, "line_id", "tokens"), vocab), "encoded")
    opt = training.Options(**options)
    if how == "cotrain":
        w, _, _ = training.train(encoded, vocab, opt, 2)
        return training.as_vectors(vocab, {"good": w[0], "bad": w[1]})
    if how == "single":
        return training.as_vectors(vocab, {"good": training.train(encoded, vocab, opt, 1)[0][0]})
    one = lambda c: training.train(encoded.where(F.col("corpus") == c).withColumn("corpus", F.lit(0)), vocab, opt, 1)[0][0]
    return training.as_vectors(vocab, {"good": one(0), "bad": one(1)})


def phrase(lines: DataFrame, thresholds: tuple[float, ...] = (200.0, 100.0), min_count: int = 5) -> DataFrame:
    """``lines(line_id, tokens)`` with phrases joined, in as many passes as there are thresholds."""
    for t in thresholds:
        merged = phrases.merge(lines, phrases.scores(lines, min_count), t)
        lines = stage(merged.select("line_id", T.blank_tokens(F.col("line")).alias("tokens")), "phrases")
    return lines


def parse_annotated(spans: DataFrame, texts: DataFrame) -> DataFrame:
    return evaluation.annotation_tokens(spans, texts)


def eval_stats(vecs: DataFrame, counts: DataFrame, marks: DataFrame, **limits) -> dict[str, DataFrame]:
    """Ranked and explained candidates, their labels, and the annotations that were missed."""
    cands = stage(evaluation.candidates(vecs, counts, **limits), "candidates")
    return {"candidates": evaluation.explained(cands, vecs, counts), "labels": evaluation.labelled(cands, marks), "missed": evaluation.missed(cands, marks, vecs, counts)}


def train_single(lines: DataFrame, vocab: DataFrame, **options) -> DataFrame:
    """Vectors of one corpus with the options of the library demo: 200 numbers, window 10, 25 noise words, 15 epochs."""
    return train(lines, vocab, "single", **{"dim": 200, "window": 10, "negative": 25, "sample": 1e-4, "epochs": 15} | options)


def compare_pred(vecs: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (40, 100, 1000)) -> dict[str, DataFrame]:
    """``queries(idx)``: per word the overlap and rank correlation of predictions within and across the models, and their statistics.

    ``details`` has a row per word, ``stats`` one per measure, as ``writers.comparison_stats_json`` writes them.
    """
    longest, lists = max(ks), None
    of = lambda m: vecs.where(F.col("model") == m).select("idx", F.col("vector").alias("vec"))
    asked = lambda m: of(m).join(queries.select("idx"), "idx").select(F.col("idx").alias("qid"), "vec", F.array().cast("array<bigint>").alias("skip"))
    for name, a, b in (("gb", "bad", "good"), ("gg", "good", "good"), ("bb", "bad", "bad")):
        top = vectors.top_products(asked(a), of(b), longest)
        listed = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda x: x["idx"]).alias(name))
        lists = listed if lists is None else lists.join(listed, "qid")
    lists = stage(lists, "lists")
    spread = vectors.predictions(asked("bad").drop("skip"), of("good"), longest, clamp=False).groupBy("qid").agg(F.stddev_pop("p").alias("prob_std1"))
    jac = [V.jaccard(F.slice(a, 1, k), F.slice("gg", 1, k)).alias(f"jac{k}_{a}") for k in ks for a in ("gb", "bb")]
    details = stage(lists.select("qid", *jac).join(evaluation.rank_correlation(lists, "gb", "gg"), "qid").join(spread, "qid"), "details")
    named = details.join(vecs.where("model = 'good'").select(F.col("idx").alias("qid"), "word"), "qid")
    return {"details": named, "stats": evaluation.describe(details, *(c for c in details.columns if c != "qid"))}


COMMANDS: dict[str, Callable] = {
    "preprocess": preprocess, "gettime": gettime, "prepare": prepare, "prepare_text2data": prepare_text2data, "text_stats": text_stats, "coverage": coverage, "vocab": vocab, "train": train,
    "phrases": phrase, "parse_annotated": parse_annotated, "eval_stats": eval_stats, "compare_vectors": vectors.cross_model, "compare": vectors.distribution_report, "predict": vectors.predictions,
    "distance": vectors.top_products, "word_analogy": vectors.analogies, "compute_accuracy": vectors.accuracy, "simulate": models.simulate_shift, "classes": models.spherical_kmeans, "linear_map": models.linear_maps,
    "train_text8": train_single, "compare_pred": compare_pred, "testplot": evaluation.panels,
}


def run(name: str, *args, **how):
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name!r}; there are {', '.join(sorted(COMMANDS))}")
    return COMMANDS[name](*args, **how)
