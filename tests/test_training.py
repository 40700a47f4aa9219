"""Training by blocks: the same sums as pair by pair, every pair of every line, at one rate for all words of a task, in time."""

import time

import numpy as np
from pyspark.sql import functions as F

from lexdrift.operators import training as TR


def _kernel(words, dim=6, **options):
    rng = np.random.default_rng(3)
    return TR.Kernel(np.full(words, 50.0), TR.Options(dim=dim, sample=0.0, **options), rng.normal(size=(2 * words, dim)).astype(np.float32), rng.normal(size=(words, dim)).astype(np.float32))


def test_a_step_of_blocks_is_the_sum_of_its_pairs():
    k = _kernel(9, window=1, negative=5)
    before, alpha = k.w.astype(np.float64), 1e-3
    ids = np.random.default_rng(4).integers(0, 9, 40)
    line = np.repeat([0, 1, 2, 3], [17, 1, 2, 20])
    k.train([(1, ids, line)], lambda done: alpha, np.random.default_rng(5))
    again = np.random.default_rng(5)
    again.random(40)  # subsampling
    noise = np.searchsorted(k.noise, again.random((3, TR.BLOCK)))
    want, loss, pairs = before.copy(), 0.0, 0
    for i in range(40):
        for j in (i - 1, i + 1):
            if 0 <= j < 40 and line[i] == line[j]:
                pairs += 1
                for word, bit, weight in [(ids[i], 1, 1.0), *((n, 0, 5 / TR.BLOCK) for n in noise[i // TR.BLOCK] if n != ids[i])]:
                    h, v = before[9 + ids[j]], before[18 + word]
                    score = 1 / (1 + np.exp(-h @ v))
                    want[9 + ids[j]] += alpha * weight * (bit - score) * v
                    want[18 + word] += alpha * weight * (bit - score) * h
                    loss -= weight * np.log(score if bit else 1 - score)
    assert k.pairs == pairs == 2 * (16 + 0 + 1 + 19)
    assert np.allclose(k.w, want, atol=1e-5) and abs(k.loss / loss - 1) < 1e-4


def test_wide_windows_and_many_draws_lose_no_pair():
    for window, negative in ((5, 5), (10, 25), (20, 40)):
        k = _kernel(30, window=window, negative=negative)
        ids, line = np.random.default_rng(6).integers(0, 30, 500), np.repeat(np.arange(5), 100)
        k.train([(0, ids, line)], lambda done: 1e-3, np.random.default_rng(7))
        assert k.seen_in.sum() == k.pairs and 0 < k.seen_out.sum() - k.pairs <= negative * k.pairs
        assert abs(k.pairs / (500 * (window + 1)) - 1) < 0.2
        assert not k.seen_in[30:].any() and np.isfinite(k.w).all()


def test_lines_are_encoded_in_order_without_unknown_words(spark):
    rows = [(0, 1, ["b", "x", "a", "b"]), (1, 1, ["a"]), (0, 2, ["x"]), (0, 3, None), (1, 4, []), (1, 5, [None, "c", "x"])]
    lines = spark.createDataFrame(rows, "corpus int, line_id bigint, tokens array<string>")
    vocab = spark.createDataFrame([(0, "c"), (1, "a"), (2, "b")], "idx bigint, word string")
    got = {(r.corpus, r.line_id): r.ids for r in TR.encode(lines, vocab).collect()}
    assert got == {(0, 1): [2, 1, 2], (1, 1): [1], (1, 5): [0]}


def test_all_words_of_a_task_are_trained_in_time(spark):
    """150,000 words of the first corpus do not leave the second at the lowest rate, and 200,000 words take seconds."""
    rows = spark.range(2000).select((F.col("id") >= 1500).cast("int").alias("corpus"), F.col("id").alias("line_id"), F.expr("transform(sequence(0, 99), x -> pmod(hash(id, x), 20) + 20 * (id % 3))").alias("ids")).coalesce(1)
    vocab = spark.range(60).select(F.col("id").alias("idx"), F.concat(F.lit("w"), "id").alias("word"), F.lit(3333).alias("cn"))
    TR.train(rows.limit(1), vocab, TR.Options(epochs=1))  # starts the workers
    began = time.time()
    w, _, _ = TR.train(rows, vocab, TR.Options(epochs=1, sample=0.0))
    took = time.time() - began
    moved = np.linalg.norm(w - TR.start_matrix(60, 100, 1), axis=2).mean(1)
    assert moved[1] > 0.1 * moved[0]
    assert took < 12
