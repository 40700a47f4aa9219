"""Iterative operators: word classes, linear maps between models, simulated meaning shift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def spherical_kmeans(rows: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """``(idx, class)`` of ``rows(idx, vec)``.

    A row starts in class idx mod k; a round takes the normalised sums of the classes and gives every row
    the class of its largest dot product, the lower one among equals. A round is one pass over the rows
    with partial sums per task; k x d numbers come to the driver, whatever the number of rows.
    """
    centres: np.ndarray | None = None

    def classes(idx: np.ndarray, m: np.ndarray) -> np.ndarray:
        return idx % k if centres is None else (m @ centres.T).argmax(1)

    def sums(batches):
        total = None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                total = np.zeros((k, m.shape[1])) if total is None else total
                np.add.at(total, classes(b.column(0).to_numpy(), m), m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["c", "s"])

    source = rows.select(F.col("idx").cast("bigint"), "vec")
    for _ in range(rounds):
        parts = source.mapInArrow(sums, "c bigint, s array<double>").select("c", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x")).collect()
        if not parts:
            break
        found = np.zeros((k, max(r["d"] for r in parts) + 1))
        for r in parts:
            found[r["c"], r["d"]] = r["x"]
        centres = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-30)

    def assign(batches):
        for b in batches:
            c = classes(b.column(0).to_numpy(), _matrix(b.column(1))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int64))], names=["idx", "class"])

    return source.mapInArrow(assign, "idx bigint, class bigint")


def linear_maps(pairs: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """``(cluster, n, heldout_n, heldout_loss, inverse_loss, w)`` from ``pairs(cluster, heldout, x, y)``.

    Per cluster the matrix W that minimises the sum of squares of Wx - y over the rows that are not held
    out, by its normal equations: tasks add up outer products, so a cluster of any size is never brought
    together. Losses are half mean squares on the held-out rows, of W and of its pseudo-inverse on y.
    """

    def moments(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            clusters, out = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            x, y = _matrix(b.column(2)), _matrix(b.column(3))
            for c in set(clusters):
                for h in (False, True):
                    at = (clusters == c) & (out == h)
                    if at.any():
                        m = held.setdefault((c, h), [0, 0.0, 0.0, 0.0])
                        m[0] += int(at.sum())
                        m[1], m[2], m[3] = m[1] + x[at].T @ x[at], m[2] + y[at].T @ x[at], m[3] + y[at].T @ y[at]
        if held:
            flat = lambda i: pa.array([v[i].reshape(-1).tolist() for v in held.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in held], pa.int64()), pa.array([h for _, h in held], pa.bool_()), pa.array([v[0] for v in held.values()], pa.int64()), flat(1), flat(2), flat(3)],
                names=["cluster", "heldout", "n", "xx", "yx", "yy"],
            )

    def solve(t):
        train, out = [], []
        for part in t.to_pylist():
            (out if part["heldout"] else train).append(part)
        if not train:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))], names=["cluster", "n", "heldout_n", "heldout_loss", "inverse_loss", "w"])
        total = lambda rows, f: np.sum([np.array(r[f]) for r in rows], axis=0)
        xx = total(train, "xx")
        d = int(round(len(xx) ** 0.5))
        w = np.linalg.solve(xx.reshape(d, d) + ridge * np.eye(d), total(train, "yx").reshape(d, d).T).T
        n = sum(r["n"] for r in out)
        loss = inverse = None
        if n:
            hx, hyx, hy = (total(out, f).reshape(d, d) for f in ("xx", "yx", "yy"))
            loss = float(np.trace(w @ hx @ w.T) - 2 * np.trace(w @ hyx.T) + np.trace(hy)) / 2 / n
            v = np.linalg.pinv(w)
            inverse = float(np.trace(v @ hy @ v.T) - 2 * np.trace(v @ hyx) + np.trace(hx)) / 2 / n
        return pa.table([[train[0]["cluster"]], [sum(r["n"] for r in train)], [n], pa.array([loss], pa.float64()), pa.array([inverse], pa.float64()), pa.array([w.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["cluster", "n", "heldout_n", "heldout_loss", "inverse_loss", "w"])

    parts = pairs.select(F.col("cluster").cast("bigint"), "heldout", "x", "y").mapInArrow(moments, "cluster bigint, heldout boolean, n bigint, xx array<double>, yx array<double>, yy array<double>")
    return parts.groupBy("cluster").applyInArrow(solve, "cluster bigint, n bigint, heldout_n bigint, heldout_loss double, inverse_loss double, w array<double>")


def _draw(*parts) -> F.Column:
    """A number in [0, 1) from the digest of the parts."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32


def shift_plan(counts: DataFrame, words: int = 10, more_than: int = 250, seed: int = 1, span: float = 10.0) -> DataFrame:
    """``(word, n, target, target_n)``: chosen words of ``counts(word, n)`` and what each is replaced by.

    Words of more than ``more_than`` occurrences and targets within a factor ``span`` are chosen by a
    digest of the word and the seed; a chosen word is no target. At most 100 words.
    """
    if not 0 <= words <= 100:
        raise ValueError("between 0 and 100 words")
    s = F.lit(str(seed))
    key = F.md5(F.concat_ws(":", "word", s).cast("binary"))
    chosen = counts.where(F.col("n") > more_than).orderBy(key, "word").limit(words)
    rest = counts.join(F.broadcast(chosen.select("word")), "word", "left_anti")
    few = F.broadcast(chosen.select(F.col("word").alias("w"), F.col("n").alias("wn")))  # at most 100 rows
    near = rest.join(few, (F.col("n") >= F.col("wn") / span) & (F.col("n") <= F.col("wn") * span))
    pick = F.struct(F.md5(F.concat_ws(":", "w", "word", s).cast("binary")), F.col("word"), F.col("n"))
    best = near.groupBy("w", "wn").agg(F.min(pick).alias("b"))
    return best.select(F.col("w").alias("word"), F.col("wn").alias("n"), F.col("b.word").alias("target"), F.col("b.n").alias("target_n"))


def simulate_shift(lines: DataFrame, plan: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """``(line_id, line)``: each occurrence of a planned word replaced by its target with probability ``percent``.

    The draw is a digest of line, place and seed, so the same input gives the same corpus.
    """
    if not 0 <= percent <= 1:
        raise ValueError("a probability")
    words = lines.select("line_id", F.posexplode("tokens").alias("pos", "word"))
    joined = words.join(F.broadcast(plan.select("word", "target")), "word", "left")  # at most 100 rows
    hit = F.col("target").isNotNull() & (_draw(F.col("line_id"), F.col("pos"), F.lit(str(seed))) < percent)
    new = joined.select("line_id", "pos", F.when(hit, F.col("target")).otherwise(F.col("word")).alias("word"))
    return new.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("line"))
