"""Vectors of words: comparison across models, neighbours, analogies, predictions.

Comparisons of a stated set of queries with all rows run on a grid of blocks: queries and rows are spread
over blocks of bounded and equal size, which keeps the copies of both few, every pair of blocks is one task,
whose product is made piece by piece, and only the best of each block and its sums are kept. Nothing of size queries x rows is ever stored unless the caller asks for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.functions import vector as V

QUERY_BLOCK, ROW_BLOCK, CELLS = 16_000, 16_000, 8_000_000  # the last: numbers of a product that are held at once


def compare_models(vectors: DataFrame, a: str = "good", b: str = "bad") -> DataFrame:
    """``(word, idx, a, b)``: the vectors of a word in two models, for words that both have."""
    x = vectors.where(F.col("model") == a).select("idx", "word", F.col("vector").alias("a"))
    return x.join(vectors.where(F.col("model") == b).select("idx", F.col("vector").alias("b")), "idx")


def cross_model(vectors: DataFrame, a: str = "good", b: str = "bad") -> DataFrame:
    """``(word, idx, sim, cosine_distance, l1)`` of each word's two vectors."""
    both = compare_models(vectors, a, b)
    sim = V.cosine(F.col("a"), F.col("b"))
    return both.select("word", "idx", sim.alias("sim"), (1 - sim).alias("cosine_distance"), V.l1(F.col("a"), F.col("b")).alias("l1"))


def unit_rows(vectors: DataFrame, model: str) -> DataFrame:
    """``(idx, vec)`` with unit vectors of one model."""
    return vectors.where(F.col("model") == model).select("idx", V.unit(F.col("vector")).alias("vec"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _grid(queries: DataFrame, rows: DataFrame, query_block: int, row_block: int):
    nq = max(1, -(-queries.count() // query_block))
    nr = max(1, -(-rows.count() // row_block))
    q = queries.withColumn("q", F.expr(f"pmod(xxhash64(qid), {nq})")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<bigint>")))
    x = rows.select(F.col("idx").alias("x_idx"), F.col("vec").alias("x_vec")).withColumn("x_r", F.expr(f"pmod(xxhash64(x_idx), {nr})")).withColumn("x_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))
    return q.groupBy("q", "r").cogroup(x.groupBy("x_q", "x_r"))


def top_products(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, positive: bool = False, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``(qid, idx, score, rank)``: for ``queries(qid, vec, skip array<bigint>)`` the k rows ``(idx, vec)`` of largest dot product.

    Rows named in ``skip`` are left out; ties (after rounding) go to the lower number; with ``positive``
    only scores above 0 count.
    """

    def best(q, x):
        out: list[list] = [[], [], []]
        if q.num_rows and x.num_rows:
            ids, idx, skips, asked = q["qid"].to_numpy(), x["x_idx"].to_numpy(), q["skip"].to_pylist(), _matrix(q["vec"])
            order = np.argsort(idx, kind="stable")
            idx, m = idx[order], _matrix(x["x_vec"])[order]
            for at in _pieces(len(ids), len(idx)):
                s = np.round(asked[at] @ m.T, digits)
                for i, row, skip in zip(ids[at], s, skips[at]):
                    if skip:
                        row[np.isin(idx, skip)] = -np.inf
                    if positive:
                        row[row <= 0] = -np.inf
                    take = np.argsort(-row, kind="stable")[:k] if len(row) <= 4 * k else _largest(row, k)
                    take = take[np.isfinite(row[take])]
                    out[0] += [i] * len(take)
                    out[1] += idx[take].tolist()
                    out[2] += row[take].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["qid", "idx", "score"])

    met = _grid(queries, rows, query_block, row_block).applyInArrow(best, "qid bigint, idx bigint, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "idx")
    return met.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _pieces(queries: int, rows: int) -> list[slice]:
    step = max(1, CELLS // max(1, rows))
    return [slice(a, a + step) for a in range(0, queries, step)]


def _largest(row: np.ndarray, k: int) -> np.ndarray:
    """The k largest, lower positions first among equals."""
    bound = np.partition(row, len(row) - k)[len(row) - k]
    near = np.flatnonzero(row >= bound)
    return near[np.argsort(-row[near], kind="stable")][:k]


def product_rows(queries: DataFrame, rows: DataFrame, digits: int = 6) -> DataFrame:
    """``(qid, idx, score)`` of every query with every row: whole matrix rows, for those who want them."""

    def full(q, x):
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["qid", "idx", "score"])
        s = np.round(_matrix(q["vec"]) @ _matrix(x["x_vec"]).T, digits)
        return pa.table([pa.array(np.repeat(q["qid"].to_numpy(), x.num_rows)), pa.array(np.tile(x["x_idx"].to_numpy(), q.num_rows)), pa.array(s.reshape(-1))], names=["qid", "idx", "score"])

    return _grid(queries.select("qid", "vec"), rows, 200, 4000).applyInArrow(full, "qid bigint, idx bigint, score double")


def _weights(s: np.ndarray, clamp: bool) -> np.ndarray:
    return np.where(s > 6, 1.0, np.where(s < -6, 0.0, np.exp(np.clip(s, -6, 6)))) if clamp else np.exp(s)


def weight_sums(queries: DataFrame, rows: DataFrame, clamp: bool = True) -> DataFrame:
    """``(qid, z, z2)``: sums of the weights exp(dot) and of their squares over all rows; the softmax's denominators.

    Clamped as in ``native_weight``; unclamped dots are expected to stay within the range of exp.
    """

    def sums(q, x):
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float64())], names=["qid", "z", "z2"])
        asked, m, z, z2 = _matrix(q["vec"]), _matrix(x["x_vec"]).T, [], []
        for at in _pieces(q.num_rows, x.num_rows):
            w = _weights(asked[at] @ m, clamp)
            z.append(w.sum(1)), z2.append((w * w).sum(1))
        return pa.table([q["qid"].combine_chunks(), pa.array(np.concatenate(z)), pa.array(np.concatenate(z2))], names=["qid", "z", "z2"])

    parts = _grid(queries.select("qid", "vec"), rows, QUERY_BLOCK, ROW_BLOCK).applyInArrow(sums, "qid bigint, z double, z2 double")
    return parts.groupBy("qid").agg(F.sum("z").alias("z"), F.sum("z2").alias("z2"))


def predictions(queries: DataFrame, rows: DataFrame, k: int = 40, clamp: bool = True) -> DataFrame:
    """``(qid, idx, p, rank)``: the k most probable contexts of every query, p = weight / sum of weights.

    One product gives both: every block of rows returns its best contexts and, as context -1, its sum of weights.
    """

    def best(q, x):
        out: list[list] = [[], [], []]
        if q.num_rows and x.num_rows:
            ids, idx, asked = q["qid"].to_numpy(), x["x_idx"].to_numpy(), _matrix(q["vec"])
            order = np.argsort(idx, kind="stable")
            idx, m = idx[order], _matrix(x["x_vec"])[order].T
            for at in _pieces(len(ids), len(idx)):
                for i, w in zip(ids[at], _weights(asked[at] @ m, clamp)):
                    take = _largest(w, k) if len(idx) > k else np.argsort(-w, kind="stable")
                    out[0] += [i] * (len(take) + 1)
                    out[1] += [*idx[take].tolist(), -1]
                    out[2] += [*w[take].tolist(), float(w.sum())]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["qid", "idx", "w"])

    met = _grid(queries.select("qid", "vec"), rows, QUERY_BLOCK, ROW_BLOCK).applyInArrow(best, "qid bigint, idx bigint, w double")
    z = F.sum(F.when(F.col("idx") == -1, F.col("w"))).over(Window.partitionBy("qid"))
    scored = met.withColumn("z", z).where("idx >= 0").select("qid", "idx", F.round(F.col("w") / F.col("z"), 9).alias("p"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("p"), "idx")).cast("bigint")).where(F.col("rank") <= k)


def distribution_report(observed: DataFrame, words: DataFrame, contexts: DataFrame, clamp: bool = True) -> DataFrame:
    """``(qid, occurrences, contexts, bhattacharyya, cosine)``: predicted against observed contexts.

    ``observed(qid, idx, n)`` is sparse; contexts never observed count in the norm of the prediction only,
    whose sum of squares comes from the grid.
    """
    z = weight_sums(words, contexts, clamp)
    dots = observed.join(words, "qid").join(contexts.withColumnRenamed("vec", "c"), "idx").select("qid", "n", V.native_weight(V.dot(F.col("vec"), F.col("c")), clamp).alias("w"))
    p = dots.join(z, "qid").withColumn("p", F.col("w") / F.col("z"))
    # a normalised prediction keeps its direction, so the cosine needs no division by z
    return p.groupBy("qid").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("contexts"), F.sum(F.sqrt(F.col("p") * F.col("n"))).alias("c"), F.sum(F.col("w") * F.col("n")).alias("wn"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("z2").alias("z2"),
    ).select("qid", "occurrences", "contexts", (-F.log(F.try_divide(F.col("c"), F.sqrt("occurrences")))).alias("bhattacharyya"), F.try_divide(F.col("wn"), F.sqrt("z2") * F.sqrt("nn")).alias("cosine"))


def analogies(questions: DataFrame, rows: DataFrame, k: int = 1) -> DataFrame:
    """``(qid, idx, score, rank)``: best rows for b - a + c of ``questions(qid, a, b, c)``; inputs left out, only positive scores.

    Questions with an unknown word have no answer.
    """
    out = questions
    for side in ("a", "b", "c"):
        out = out.join(rows.select(F.col("idx").alias(side), F.col("vec").alias(f"v{side}")), side)
    target = F.zip_with(F.zip_with("vb", "va", lambda x, y: x - y), "vc", lambda x, y: x + y)
    return top_products(out.select("qid", V.unit(target).alias("vec"), F.array("a", "b", "c").alias("skip")).where("vec is not null"), rows, k, positive=True)


def accuracy(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``(section, correct, seen, total)`` per section and, where the section is null, over all."""
    joined = questions.join(answers.where("rank = 1").select("qid", F.col("idx").alias("answer")), "qid", "left")
    return joined.rollup("section").agg(F.count_if(F.col("answer") == F.col("expected")).alias("correct"), F.count("answer").alias("seen"), F.count("*").alias("total"))


def phrase_queries(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """``(qid, vec, skip)`` of ``terms(qid, idx)``: normalised sums of unit vectors; a query with an unknown word has none."""
    known = terms.join(rows, "idx", "left").groupBy("qid").agg(
        F.count_if(F.col("vec").isNull()).alias("unknown"), F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("t")
    ).where("unknown = 0")
    summed = F.aggregate(F.slice("t", 2, 1000), F.get("t", F.lit(0))["vec"], lambda s, x: F.zip_with(s, x["vec"], lambda a, b: a + b))
    return known.select("qid", V.unit(summed).alias("vec"), F.transform("t", lambda x: x["idx"]).alias("skip")).where("vec is not null")


def neighbour_lists(queries: DataFrame, rows: DataFrame, words: DataFrame, counts: DataFrame, count: Column, least: int = 10, k: int = 100) -> DataFrame:
    """``(qid, words)``: words of the k nearest rows, of those with a count of at least ``least``, nearest first."""
    top = top_products(queries, rows, k).join(words.select("idx", "word"), "idx").join(counts, "word").where(count >= least)
    return top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("words"))
