"""Vocabularies: counts per corpus, coverage, alignment, probabilities, Huffman codes."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.operators.order import numbered

END = "</s>"


def two_corpus_counts(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """``(word, cn, gcn, bcn)`` of ``tokens(corpus, word)``; the end mark counts once per row of ``lines(corpus)``.

    Corpora are ``good`` and ``bad``. Counting is partial before the shuffle.
    """
    all_words = tokens.select("corpus", "word").union(lines.select("corpus", F.lit(END).alias("word")))
    return all_words.groupBy("word").agg(F.count("*").alias("cn"), F.count_if(F.col("corpus") == "good").alias("gcn"), F.count_if(F.col("corpus") == "bad").alias("bcn"))


def indexed(counts: DataFrame, min_count: int = 5) -> DataFrame:
    """``(idx, word, cn, gcn, bcn)``: words of at least ``min_count``, the end mark first, then by count and word.

    The numbers come from a sort by ranges and the sizes of its partitions, not from one task.
    """
    kept = counts.where((F.col("cn") >= min_count) | (F.col("word") == END))
    return numbered(kept, "idx", F.col("word") != END, F.col("cn").desc(), F.col("word")).select("idx", "word", "cn", "gcn", "bcn")


def common(counts: DataFrame) -> DataFrame:
    """Words that both corpora have."""
    return counts.where("gcn > 0 and bcn > 0")


def shared_or_frequent(dark: DataFrame, white: DataFrame, frequent: int = 200) -> DataFrame:
    """``(word)``: in both vocabularies ``(word, n)``, or at least ``frequent`` times in the dark one."""
    return dark.select("word").intersect(white.select("word")).union(dark.where(F.col("n") >= frequent).select("word")).distinct()


def aligned_lines(sentences: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(thread, line)``: per thread its sentences made of allowed words only, in their order.

    ``sentences(thread, at, tokens)``. A sentence with a word outside is found by an anti join on words, so
    the allowed vocabulary may be of any size.
    """
    words = sentences.select("thread", "at", F.explode("tokens").alias("word"))
    foreign = words.join(allowed.select("word"), "word", "left_anti").select("thread", "at").distinct()
    kept = sentences.join(foreign, ["thread", "at"], "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.array_join("tokens", " ").alias("s"))))
    return kept.groupBy("thread").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("line"))


def without_rare_words(lines: DataFrame, more_than: int = 10) -> DataFrame:
    """``(line_id, tokens)`` without the words that occur ``more_than`` times or less; lines left empty are dropped."""
    words = lines.select("line_id", F.posexplode("tokens").alias("pos", "word"))
    frequent = words.groupBy("word").count().where(F.col("count") > more_than).select("word")
    kept = words.join(frequent, "word", "left_semi")
    return kept.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("tokens"))


def coverage_summary(vocab: DataFrame, frequent: int = 10) -> DataFrame:
    """One row per ``label`` of ``vocab(label, word, n)``: totals, distinct and frequent words, coverage."""
    f = F.col("n") > frequent
    return vocab.groupBy("label").agg(
        F.sum("n").alias("total"), F.count("*").alias("words"), F.count_if(f).alias("frequent_words"), F.coalesce(F.sum(F.when(f, F.col("n"))), F.lit(0)).alias("frequent_total")
    ).withColumn("coverage", F.round(F.col("frequent_total") / F.col("total"), 9))


def coverage_histogram(vocab: DataFrame, upto: int = 10, samples: int = 5) -> DataFrame:
    """``(label, n, words, remain, samples)``: words that occur n = 1..upto times, words left after them, the first samples by hash.

    Samples are the smallest by (md5, word), kept per partition and merged, so no list grows with the data.
    """
    low = vocab.where(F.col("n") <= upto).withColumn("h", F.md5(F.col("word").cast("binary")))
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("label", "n").orderBy("h", "word"))).where(F.col("r") <= samples)
    shown = ranked.groupBy("label", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("samples"))
    per = vocab.groupBy("label", "n").agg(F.count("*").alias("words"))
    total = vocab.groupBy("label").agg(F.count("*").alias("all_words"))
    running = F.sum("words").over(Window.partitionBy("label").orderBy("n"))
    return (
        per.where(F.col("n") <= upto).join(total, "label").withColumn("remain", F.col("all_words") - running)
        .join(shown, ["label", "n"]).select("label", "n", "words", "remain", "samples")
    )


def keep_probability(cn: Column, total: Column, sample: float = 1e-3) -> Column:
    """Probability that an occurrence of a word of count ``cn`` survives frequency subsampling."""
    t = F.lit(sample) * total
    return F.least((F.sqrt(cn / t) + 1) * t / cn, F.lit(1.0))


def negative_distribution(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """``(word, p)``: counts to a power, normalised."""
    w = counts.select("word", F.pow(F.col("cn").cast("double"), F.lit(power)).alias("w"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("z")))).select("word", (F.col("w") / F.col("z")).alias("p"))  # one row


def huffman(counts: list[tuple[str, int]]) -> list[tuple[str, str, list[int]]]:
    """``(word, code, path)`` by merging the two smallest counts; for vocabularies that training holds in memory anyway.

    Inner nodes are numbered in the order in which they arise; the path runs from the root. Ties go to
    leaves of lower count order first, then to older inner nodes.
    """
    n = len(counts)
    if n < 2:
        return [(w, "", []) for w, _ in counts]
    heap = [(c, 0, i) for i, (_, c) in sorted(enumerate(counts), key=lambda x: (x[1][1], -x[0]))]
    heap = [(c, 0, n - 1 - i, i) for c, _, i in heap]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for k in range(n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[3]], up[b[3]] = (n + k, 0), (n + k, 1)
        heapq.heappush(heap, (a[0] + b[0], 1, k, n + k))
    out = []
    for i, (word, _) in enumerate(counts):
        code, path, at = [], [], i
        while at in up:
            at, bit = up[at]
            code.append(bit)
            path.append(at - n)
        out.append((word, "".join(map(str, reversed(code))), path[::-1]))
    return out
