"""Embedding training: skip-gram or continuous bag of words, negative sampling or hierarchical softmax,
on one corpus, on two separately, or on two with a shared output matrix.

Every epoch the tasks train on their lines from the same starting point and the changed rows are averaged
by how often each was changed. This is synchronous and reproducible where the lock-free original is not.
Skip-gram with negative sampling takes every window of every line in blocks of places (``BLOCK``): the pairs of a
block and the noise words drawn for it are one small matrix product. Each pair is trained against all draws of its
block, at weights that add up to ``negative``, which is in the mean the same as draws of its own.
The vocabulary and its matrices are held by every worker, so their size is bounded (``WORDS_AT_MOST``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdrift.operators.vocabulary import huffman

WORDS_AT_MOST = 1_000_000
BLOCK = 16


@dataclass(frozen=True)
class Options:
    dim: int = 100
    window: int = 5
    negative: int = 5
    hierarchical: bool = False
    cbow: bool = False
    epochs: int = 5
    sample: float = 1e-3
    alpha: float | None = None  # 0.025, or 0.05 for continuous bag of words
    min_count: int = 5
    seed: int = 1
    batch: int = 512

    def rate(self) -> float:
        return self.alpha if self.alpha is not None else (0.05 if self.cbow else 0.025)


def start_matrix(words: int, dim: int, seed: int) -> np.ndarray:
    """Uniform in +-0.5 / dim, from a seed."""
    return ((np.random.default_rng(seed).random((words, dim)) - 0.5) / dim).astype(np.float32)


class Kernel:
    """Trains on encoded lines. ``w_in`` has one block of rows per corpus, ``w_out`` is shared."""

    def __init__(self, counts: np.ndarray, opt: Options, w_in: np.ndarray, w_out: np.ndarray, codes=None) -> None:
        self.opt, self.words, self.w = opt, len(counts), np.concatenate([w_in, w_out])
        self.w_in, self.w_out = self.w[: len(w_in)], self.w[len(w_in) :]
        total = max(1, counts.sum())
        t = opt.sample * total
        self.keep = np.minimum(1.0, (np.sqrt(counts / t) + 1) * t / np.maximum(counts, 1)) if opt.sample > 0 else np.ones(len(counts))
        p = counts.astype(np.float64) ** 0.75
        self.noise = np.cumsum(p / p.sum())
        self.codes = codes  # (points, bits, mask), padded
        self.far = np.abs(np.arange(BLOCK + 2 * opt.window)[:, None] - opt.window - np.arange(BLOCK)).astype(np.int16)
        self.seen = np.zeros(len(self.w))
        self.seen_in, self.seen_out = self.seen[: len(w_in)], self.seen[len(w_in) :]
        self.loss, self.pairs = 0.0, 0

    def train(self, runs, alpha_of, rng) -> None:
        """``runs`` yields (corpus, word numbers, their lines); ``alpha_of`` gives the rate after that many words."""
        done = 0
        shared = self.opt.negative and not (self.opt.cbow or self.opt.hierarchical)
        for corpus, ids, line in runs:
            at = np.flatnonzero(rng.random(len(ids)) < self.keep[ids])
            if len(at):
                (self._in_blocks if shared else self._in_windows)(corpus * self.words, ids[at], line[at], done + at, alpha_of, rng)
            done += len(ids)

    def _padded(self, ids: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and lines with a window of places before them, up to ``size`` places; added places are lines of their own."""
        word, own = np.zeros(size, np.int64), -1 - np.arange(size, dtype=np.int32)
        at = slice(self.opt.window, self.opt.window + len(ids))
        word[at], own[at] = ids, line
        return word, own

    def _in_windows(self, offset, ids, line, done, alpha_of, rng) -> None:
        """Centres and their contexts (padded with -1), with a window drawn per place."""
        n, w = len(ids), self.opt.window
        word, own = self._padded(ids, line, n + 2 * w)
        offsets = np.r_[-w:0, 1 : w + 1]
        for a in range(0, n, self.opt.batch):
            here = np.arange(a, min(n, a + self.opt.batch)) + w
            near = here[:, None] + offsets
            good = (np.abs(offsets) <= rng.integers(1, w + 1, (len(here), 1))) & (own[near] == own[here, None])
            self._batch(offset, word[here], np.where(good, word[near], -1), alpha_of(done[here[-1] - w]), rng)

    def _in_blocks(self, offset, ids, line, done, alpha_of, rng) -> None:
        """About as many pairs a step as ``_step`` takes."""
        n, w = len(ids), self.opt.window
        blocks, beyond = -(-n // BLOCK), -(-2 * w // BLOCK)
        word, own = self._padded(ids, line, (blocks + beyond) * BLOCK)
        step = max(1, round(4 * self.opt.batch / (w + 1) / BLOCK))
        for a in range(0, blocks, step):
            b = min(blocks, a + step)
            part = slice(a * BLOCK, (b + beyond) * BLOCK)
            self._blocks(offset, word[part], own[part], b - a, np.float32(alpha_of(done[min(n, b * BLOCK) - 1])), rng)

    def _blocks(self, offset, word, own, blocks, alpha, rng) -> None:
        """One step: the places of a block are centres, they and a window of places on both sides are inputs."""
        w, draws = self.opt.window, max(BLOCK, self.opt.negative)
        inputs = word + offset
        h, line = _overlapping(self.w[inputs], blocks, BLOCK + 2 * w), _overlapping(own, blocks, BLOCK + 2 * w)
        here = word[w : w + blocks * BLOCK].reshape(blocks, BLOCK)
        noise = np.searchsorted(self.noise, rng.random((blocks, draws))).clip(0, self.words - 1)
        out = np.concatenate([here, noise], 1)
        v = self.w_out[out]
        within = (self.far > 0) & (self.far <= rng.integers(1, w + 1, (blocks, 1, BLOCK), np.int16))
        use = np.empty((blocks, BLOCK + 2 * w, BLOCK + draws), np.float32)
        pair, drawn = use[:, :, :BLOCK], use[:, :, BLOCK:]
        within &= line[:, :, None] == line[:, None, w : w + BLOCK]
        pair[:] = within
        pairs = pair.sum(2)
        # a draw does not count against the pairs that have it as target
        np.subtract(pairs[:, :, None], pair @ (here[:, :, None] == noise[:, None, :]).astype(np.float32), out=drawn)
        drawn *= np.float32(self.opt.negative / draws)
        score = h @ v.transpose(0, 2, 1)
        np.clip(score, -6, 6, out=score)
        score[:, :, :BLOCK] *= -1
        np.exp(score, out=score)
        score += 1  # its logarithm is the loss of an entry, and 1 less its inverse the gradient's size
        self.loss += float(np.vdot(use, np.log(score)))
        self.pairs += int(pairs.sum())
        g = np.reciprocal(score, out=score)
        np.subtract(1, g, out=g)
        g *= use
        g[:, :, BLOCK:] *= -1
        rows = np.concatenate([inputs, out.reshape(-1) + len(self.w_in)])
        grads = np.zeros((len(rows), h.shape[2]), np.float32)
        _fold(g @ v, grads[: len(inputs)])
        np.matmul(g.transpose(0, 2, 1), h, out=grads[len(inputs) :].reshape(v.shape))
        hits = np.zeros(len(rows), np.float32)
        _fold(pairs, hits[: len(inputs)])
        np.sum(use, 1, out=hits[len(inputs) :].reshape(out.shape))
        _add(self.w, self.seen, rows, grads, hits, 1 / alpha, alpha)

    def _batch(self, offset, centre, context, alpha, rng) -> None:
        if self.opt.cbow:
            some = (context >= 0).any(1)
            inputs, targets = context[some], centre[some]
        else:
            r, c = np.nonzero(context >= 0)
            inputs, targets = context[r, c][:, None], centre[r]
        step = 4 * self.opt.batch
        for a in range(0, len(targets), step):
            self._step(offset, inputs[a : a + step], targets[a : a + step], alpha, rng)

    def _step(self, offset, inputs, targets, alpha, rng) -> None:
        mask = (inputs >= 0).astype(np.float32)
        rows = np.where(inputs >= 0, inputs + offset, 0)
        share = mask / np.maximum(mask.sum(1, keepdims=True), 1)
        h = np.einsum("bmd,bm->bd", self.w_in[rows], share)
        outs, bits, weight = [], [], []
        if self.opt.negative:
            noise = np.searchsorted(self.noise, rng.random((len(targets), self.opt.negative))).clip(0, self.words - 1)
            outs.append(np.c_[targets, noise])
            bits.append(np.c_[np.ones(len(targets)), np.zeros(noise.shape)])
            weight.append(np.c_[np.ones(len(targets)), noise != targets[:, None]])
        if self.opt.hierarchical:
            points, codes, there = self.codes
            outs.append(points[targets] + self.words)
            bits.append(1 - codes[targets])
            weight.append(there[targets])
        out, bit, use = np.concatenate(outs, 1), np.concatenate(bits, 1).astype(np.float32), np.concatenate(weight, 1).astype(np.float32)
        v = self.w_out[out]
        score = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bod->bo", h, v), -6, 6)))
        g = (bit - score) * use * np.float32(alpha)
        self.loss += float(-(use * np.log(np.maximum(np.where(bit > 0, score, 1 - score), 1e-7))).sum())
        self.pairs += len(targets)
        grad_h = np.einsum("bo,bod->bd", g, v)
        _add(self.w_out, self.seen_out, out.reshape(-1), (g[..., None] * h[:, None, :]).reshape(-1, h.shape[1]), use.reshape(-1) > 0, 4)
        spread = np.broadcast_to(grad_h[:, None, :], (*rows.shape, h.shape[1])) * mask[..., None]
        _add(self.w_in, self.seen_in, rows.reshape(-1), spread.reshape(-1, h.shape[1]), mask.reshape(-1), 4)


def _overlapping(x: np.ndarray, blocks: int, size: int) -> np.ndarray:
    """A view of ``blocks`` windows of ``size`` rows that begin ``BLOCK`` rows apart."""
    return np.lib.stride_tricks.as_strided(x, (blocks, size, *x.shape[1:]), (BLOCK * x.strides[0], *x.strides), writeable=False)


def _fold(x: np.ndarray, out: np.ndarray) -> None:
    """Add to each row of ``out`` what ``_overlapping`` windows have for it."""
    out = out.reshape(-1, BLOCK, *x.shape[2:])
    for k in range(len(out) - len(x) + 1):
        part = x[:, k * BLOCK : (k + 1) * BLOCK]
        out[k : k + len(x), : part.shape[1]] += part


def _summed(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repetition, in order, and the sums of their lines of ``x``, which is overwritten: neighbours are added until none is left."""
    at = np.argsort(rows)
    rows = rows[at]
    while True:
        begins = np.empty(len(rows), bool)
        begins[:1] = True
        np.not_equal(rows[1:], rows[:-1], out=begins[1:])
        if begins.all():
            return rows, x[at]
        place = np.arange(len(rows))
        odd = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 1
        i = np.flatnonzero(odd)
        x[at[i - 1]] += x[at[i]]
        at, rows = at[~odd], rows[~odd]


def _add(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, grads: np.ndarray, hits: np.ndarray, most: float, rate: float = 1.0) -> None:
    """Add gradients times ``rate``; a row hit more than ``most`` times in one step takes that many times the mean, so that a step stays bounded."""
    hit, total = _summed(rows, grads)
    n = np.bincount(np.searchsorted(hit, rows), hits, len(hit))
    total *= (rate / np.maximum(1.0, n / most)).astype(w.dtype)[:, None]
    w[hit] += total
    seen[hit] += n


def _held(vocab: DataFrame) -> list:
    words = vocab.orderBy("idx").limit(WORDS_AT_MOST + 1).collect()
    if len(words) > WORDS_AT_MOST:
        raise ValueError(f"more than {WORDS_AT_MOST} words; raise min_count")
    return words


def encode(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(corpus, line_id, ids)``: lines as numbers of known words, in their order; lines without any are dropped.

    ``lines(corpus, line_id, tokens)``, ``vocab(idx, word)``, which training holds in memory anyway. Lines are spread by hash.
    """
    known = [(r["word"], r["idx"]) for r in _held(vocab.select("word", "idx")) if r["word"] is not None]
    sent = lines.sparkSession.sparkContext.broadcast(([w for w, _ in known], [i for _, i in known]))

    def run(batches):
        words, idx = (pa.array(x, t) for x, t in zip(sent.value, (pa.string(), pa.int64())))
        for batch in batches:
            tokens = batch.column(2)
            at = pa.compute.index_in(tokens.flatten(), value_set=words, skip_nulls=True)
            line = np.repeat(np.arange(len(tokens)), pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy())
            n = np.bincount(line[at.is_valid().to_numpy(zero_copy_only=False)], minlength=len(tokens))
            some = pa.array(np.flatnonzero(n))
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[n > 0])], pa.int32()), idx.take(at.drop_null()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), ids], names=["corpus", "line_id", "ids"])

    some = lines.select("corpus", "line_id", F.col("tokens").cast("array<string>").alias("tokens"))
    schema = T.StructType([*some.schema.fields[:2], T.StructField("ids", T.ArrayType(T.LongType()))])
    return some.mapInArrow(run, schema).repartition("corpus", "line_id")


def _codes(counts: list[tuple[str, int]]):
    tree = huffman(counts)
    depth = max((len(c) for _, c, _ in tree), default=0)
    points, bits, there = (np.zeros((len(tree), max(1, depth)), t) for t in (np.int64, np.float32, np.float32))
    for i, (_, code, path) in enumerate(tree):
        k = len(code)
        points[i, :k], bits[i, :k], there[i, :k] = path, [int(b) for b in code], 1
    return points, bits, there


def train(encoded: DataFrame, vocab: DataFrame, opt: Options = Options(), corpora: int = 2):
    """Input matrix ``(corpora, words, dim)``, output matrix and losses per epoch.

    ``encoded(corpus 0.., line_id, ids)``, staged by the caller; ``vocab(idx, word, cn)`` numbered from 0.
    Corpora start from equal input matrices and share the output matrix; one corpus is plain training.
    """
    words = _held(vocab)
    counts = np.array([r["cn"] for r in words], np.float64)
    v = len(words)
    codes = _codes([(r["word"], r["cn"]) for r in words]) if opt.hierarchical else None
    w_in = np.concatenate([start_matrix(v, opt.dim, opt.seed)] * corpora)
    w_out = np.zeros((v * (2 if opt.hierarchical else 1), opt.dim), np.float32)
    losses: list[float] = []
    sc = encoded.sparkSession.sparkContext
    # the rate falls over all words of a task, which has about as many as any other
    per_task = max(1.0, (encoded.agg(F.sum(F.size("ids"))).first()[0] or 0) / max(1, encoded.rdd.getNumPartitions()))
    for epoch in range(opt.epochs):
        sent = sc.broadcast((w_in, w_out))
        w_in, w_out, loss = _epoch(encoded, counts, opt, sent, codes, epoch, per_task, w_in, w_out)
        sent.unpersist()
        losses.append(loss)
    return w_in.reshape(corpora, v, opt.dim), w_out, losses


def _epoch(encoded, counts, opt, sent, codes, epoch, per_task, w_in, w_out):
    first, last = opt.rate() * (1 - epoch / opt.epochs), opt.rate() * (1 - (epoch + 1) / opt.epochs)
    floor = opt.rate() * 1e-4

    def alpha_of(done: int) -> float:
        return max(floor, first - (first - last) * min(1.0, done / per_task))

    def run(batches):
        a, b = sent.value
        k = Kernel(counts, opt, a, b, codes)
        rng = np.random.default_rng([opt.seed, epoch, TaskContext.get().partitionId()])

        def runs():
            for batch in batches:
                corpus, lists = batch.column(0).to_numpy(), batch.column(1)
                size = pa.compute.list_value_length(lists).to_numpy()
                ids, line, end = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size), np.cumsum(np.r_[0, size])
                turn = [0, *np.flatnonzero(np.diff(corpus)) + 1, len(corpus)]
                for at, to in zip(turn, turn[1:]):
                    if at < to:
                        yield int(corpus[at]), ids[end[at] : end[to]], line[end[at] : end[to]]

        k.train(runs(), alpha_of, rng)
        for which, (w, old, seen) in enumerate(((k.w_in, a, k.seen_in), (k.w_out, b, k.seen_out))):
            rows = np.flatnonzero(seen)
            for at in range(0, len(rows), 10_000):
                r = rows[at : at + 10_000]
                yield _changes(which, r, (w[r] - old[r]), seen[r])
        yield _changes(2, np.zeros(1, np.int64), np.array([[k.loss]]), np.array([max(1, k.pairs)]))

    # a task trains on one corpus after the other; even tasks begin with the first, odd ones with the second
    turns = encoded.select("corpus", "ids").sortWithinPartitions(F.expr("pmod(corpus + spark_partition_id(), 2)"))
    changed = turns.mapInArrow(run, "which int, row bigint, delta array<float>, n double")

    def average(t):
        n, d = t["n"].to_numpy().astype(np.float64), _numbers(t["delta"]).astype(np.float64)
        row = t["row"].to_numpy()
        order, at = np.unique(row, return_inverse=True)
        total = np.bincount(at, n, len(order))
        out = _summed(row, d * (1.0 if t["which"][0].as_py() == 2 else (n / total[at])[:, None]))[1]
        return pa.table([pa.array([t["which"][0].as_py()] * len(order), pa.int32()), pa.array(order), _lists(out), pa.array(total)], names=["which", "row", "delta", "n"])

    # as many rows as the matrices have, which every worker holds anyway
    merged = changed.withColumn("block", F.col("row") % 64).groupBy("which", "block").applyInArrow(lambda t: average(t), "which int, row bigint, delta array<float>, n double").toArrow()
    loss = 0.0
    for which in (0, 1, 2):
        part = merged.filter(pa.compute.equal(merged["which"], which))
        if not part.num_rows:
            continue
        if which == 2:
            loss = float(part["delta"][0].as_py()[0]) / part["n"][0].as_py()
            continue
        w = (w_in, w_out)[which]
        w[part["row"].to_numpy()] += _numbers(part["delta"])
    return w_in, w_out, loss


def _numbers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(m, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))


def _changes(which: int, rows: np.ndarray, delta: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([which] * len(rows), pa.int32()), pa.array(rows.astype(np.int64)), _lists(delta), pa.array(n.astype(np.float64))],
        names=["which", "row", "delta", "n"],
    )


def as_vectors(vocab: DataFrame, matrices: dict[str, np.ndarray]) -> DataFrame:
    """``(model, word, idx, vector)`` of trained matrices by model name."""
    spark = vocab.sparkSession
    parts = []
    for name, m in matrices.items():
        t = pa.table([pa.array([name] * len(m)), pa.array(np.arange(len(m))), _lists(m).cast(pa.list_(pa.float64()))], names=["model", "idx", "vector"])
        parts.append(spark.createDataFrame(t))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.join(vocab.select("idx", "word"), "idx").select("model", "word", "idx", "vector")
