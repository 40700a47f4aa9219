"""Reading level: a linear pairwise ranker on syntax and vocabulary features, calibrated by isotonic regression.

The ranker is fitted on pairs of rated documents of different levels (logistic loss on the difference of
their features), so it learns an order rather than the raters' numbers. Isotonic regressions of "rated
at least 2" and "rated at least 3" on the score turn the score into levels. At most ``LABELLED`` rated
documents, chosen by a hash of their ids, are brought to the driver; the features of all documents are
computed in one pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, PAIRS = 20_000, 120_000
_SENTENCE = re.compile(r"[.!?]+[\"')\]]*\s+|\n+")
# Words that tie clauses together.
LINKS = set("although because whereas notwithstanding insofar given which whose however consequently considerably unless provided particularly".split())
LENGTHS = np.array([4, 6, 8, 11, 15, 20, 27])  # words in a sentence
LETTERS = np.array([3.4, 3.9, 4.4, 5.0, 5.7, 6.6, 7.8])  # characters per word
N_FEATURES = 2 * (len(LENGTHS) + 1) + (len(LENGTHS) + 1) * (len(LETTERS) + 1) + 22


def features(text: str) -> np.ndarray:
    """Shares of sentences by length and by length of words, of long and short words, of clauses and marks."""
    n, m = len(LENGTHS) + 1, len(LETTERS) + 1
    out = np.zeros(N_FEATURES)
    said = [s for s in _SENTENCE.split(text) if s and not s.isspace()]
    if not said:
        return out
    words = np.fromiter((s.count(" ") + 1 for s in said), float, len(said))
    chars = np.fromiter(map(len, said), float, len(said))
    a, b = np.searchsorted(LENGTHS, words, side="right"), np.searchsorted(LETTERS, (chars - words + 1) / words, side="right")
    total = words.sum()
    out[:n] = np.bincount(a, minlength=n) / len(said)
    out[n : n + m] = np.bincount(b, minlength=m) / len(said)
    out[n + m : n + m + n * m] = np.bincount(a * m + b, minlength=n * m) / len(said)
    k = n + m + n * m
    tokens = text.split()
    sizes = np.minimum(np.fromiter(map(len, tokens), np.int64, len(tokens)), 16)
    out[k : k + 17] = np.bincount(sizes, minlength=17) / len(tokens)
    out[k + 17] = sum(map(LINKS.__contains__, tokens)) / len(said)
    out[k + 18] = text.count(",") / len(said) / 3
    out[k + 19] = np.log1p(total / len(said)) / 3
    out[k + 20] = (chars.sum() - total) / total / 6
    out[k + 21] = len(set(tokens)) / len(tokens)
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values of the least-squares fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, 1, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, _, e = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = e
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return knots, values


class LevelModel:
    def __init__(self, levels: int = 3) -> None:
        self.levels, self.w, self.mean, self.sd, self.cuts = levels, None, None, None, []

    def fit(self, x: np.ndarray, rated: np.ndarray, pairs: int = PAIRS, epochs: int = 25, seed: int = 5) -> "LevelModel":
        """``rated``: mean rating per document. Without ratings of different levels everything is of level 2."""
        self.mean, self.sd = x.mean(0) if len(x) else np.zeros(N_FEATURES), (x.std(0) if len(x) else np.ones(N_FEATURES)) + 1e-6
        z = (x - self.mean) / self.sd
        rng = np.random.default_rng(seed)
        n = len(z)
        self.w = np.zeros(z.shape[1] if n else N_FEATURES)
        if n < 2 or rated.min() == rated.max():
            self.cuts = [-np.inf] + [np.inf] * (self.levels - 2)
            return self
        i, j = rng.integers(0, n, pairs), rng.integers(0, n, pairs)
        apart = rated[i] - rated[j] >= 0.75
        i, j = i[apart], j[apart]
        m, v, t = np.zeros_like(self.w), np.zeros_like(self.w), 0
        for _ in range(epochs):
            order = rng.permutation(len(i))
            for at in range(0, len(order), 8192):
                p = order[at : at + 8192]
                d = z[i[p]] - z[j[p]]
                g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ self.w, -30, 30))))) / len(p) + 0.002 * self.w
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                self.w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        score = z @ self.w
        self.cuts = []
        for level in range(2, self.levels + 1):
            knots, values = isotonic(score, (rated >= level - 0.5).astype(float))
            above, below = knots[values >= 0.5], knots[values < 0.5]
            self.cuts.append(float(above.min() + below.max()) / 2 if len(above) and len(below) else (-np.inf if len(above) else np.inf))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd @ self.w

    def levels_of(self, x: np.ndarray) -> np.ndarray:
        return 1 + sum((self.scores(x) >= c).astype(np.int64) for c in self.cuts)


def _measured(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        x = [features(t or "").tolist() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "rated"])


def fit_levels(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> LevelModel:
    """From ``labels(doc_id, level)`` and ``documents(doc_id, text)``: ratings of a document are averaged, null ones ignored."""
    rated = labels.where("doc_id is not null and level is not null").groupBy("doc_id").agg(F.avg("level").alias("rated"))
    # at most ``labelled`` pairs of numbers, so the broadcast below has a size bound
    drawn = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = (
        documents.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "rated")
        .mapInArrow(_measured, "doc_id bigint, x array<double>, rated double").collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return LevelModel().fit(np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES), np.array([r["rated"] for r in rows], float))


def levels(documents: DataFrame, model: LevelModel) -> DataFrame:
    """``(doc_id, level, score)``: one row per row of ``documents(doc_id, text)``; null and empty texts score as texts without sentences."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                x = np.array([features(t or "") for t in part.column(1).to_pylist()], float).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.levels_of(x), pa.int64()), pa.array(model.scores(x))], names=["doc_id", "level", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, level bigint, score double")
