import random

import numpy as np
import pytest

from lexdrift.llm import mixing as X
from lexdrift.llm import packing as P
from lexdrift.llm import tokens as T


def test_best_fit_places_every_item_once():
    rng = random.Random(3)
    for open_bins in (1, 3, 64):
        b, out = P.BestFit(100, open_bins), []
        items = [rng.randint(0, 100) for _ in range(3000)]
        for i, n in enumerate(items):
            out += b.put(n, (i, n))
            assert b.count <= open_bins
        out += b.rest()
        assert sorted(i for _, pieces in out for i, _ in pieces) == list(range(3000))
        assert all(filled == sum(n for _, n in pieces) <= 100 for filled, pieces in out)


def test_fullest_closes_first_and_tightest_holds():
    b = P.BestFit(10, 2)
    assert b.put(6, "a") == [] and b.put(7, "b") == []
    assert b.put(3, "c") == [(10, ["b", "c"])]
    assert b.put(8, "d") == []
    assert b.put(5, "e") == [(8, ["d"])]
    assert b.rest() == [(6, ["a"]), (5, ["e"])]


def test_cut():
    assert P.cut(5, 10) == [(0, 0, 5)] and P.cut(0, 10) == [(0, 0, 0)]
    assert P.cut(25, 10) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 90), 0) for i in range(500)] + [(900, None, 0), (901, "", 0), (902, "word " * 5000, 0), (903, "same", 0), (903, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, capacity int").repartition(5)
    sizes = spark.createDataFrame([(1, 100), (2, 64)], "bin_size_id int, capacity_tokens int")
    got = P.pack(docs, sizes).collect()
    from lexdrift.llm.tokens import sizes as count

    for bin_id, capacity in ((1, 100), (2, 64)):
        mine = [r for r in got if r.bin_size_id == bin_id]
        by = {}
        for r in mine:
            by.setdefault(r.container, []).append(r)
        assert all(sum(r.tokens for r in c) == c[0].filled <= capacity for c in by.values())
        whole = {}
        for r in mine:
            whole.setdefault(r.doc_id, []).append(r)
        for doc, text, _ in rows:
            if text is None:
                assert doc not in whole
                continue
            n = count([text])[0]
            assert sum(r.tokens for r in whole[doc]) == n * (2 if doc == 903 else 1)
            assert len(whole[doc]) == max(1, -(-n // capacity)) * (2 if doc == 903 else 1)
        fill = sum(r.tokens for r in mine) / (capacity * len(by))
        assert fill > 0.93
    assert P.pack(docs.limit(0), sizes).count() == 0
    with pytest.raises(ValueError):
        P.pack(docs, spark.createDataFrame([(1, 0)], "bin_size_id int, capacity_tokens int"))


def test_rake_meets_shares_under_caps():
    rng = random.Random(5)
    cells = [(s, lang, t, float(rng.randint(1, 1000))) for s in "abc" for lang in ("en", "de") for t in ("x", "y")]
    targets = {"a": (0.5, 2), "b": (0.3, 4), "c": (0.2, 8)}
    w, total, wanted = X.rake(cells, targets)
    for s, (share, cap) in targets.items():
        used = sum(x * c[3] for x, c in zip(w, cells) if c[0] == s)
        assert used == pytest.approx(share * total, rel=1e-6)
        assert all(x <= cap + 1e-9 for x, c in zip(w, cells) if c[0] == s)
    for axis, at in (("lang", 1), ("topic", 2)):
        for v, share in wanted[axis].items():
            assert sum(x * c[3] for x, c in zip(w, cells) if c[at] == v) == pytest.approx(share * total, rel=0.02)
    smaller, size, _ = X.rake(cells, targets, total=100.0)
    assert size == 100.0 and sum(x * c[3] for x, c in zip(smaller, cells)) == pytest.approx(100.0)


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab") if i < 900 else "c", rng.choice(["en", "de", None]), "word " * rng.randint(1, 60), 1) for i in range(1000)]
    rows += [(2000, None, "en", "x", 1), (2001, "a", "en", None, 1), (2002, "z", "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, s int")
    targets = spark.createDataFrame([("a", 0.4, 1, 0), ("b", 0.3, 2, 0), ("c", 0.3, 5, 0)], "source string, target_share double, max_repeats int, copies int")
    mixed = X.mixture(docs, targets)
    report = {r.source: r for r in X.share_report(mixed, targets).collect()}
    for s, share, cap in (("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 5)):
        assert report[s].actual_share == pytest.approx(share, abs=0.01) and report[s].most_copies <= cap
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert X.mixture(docs.limit(0), targets).count() == 0
    more = targets.union(spark.createDataFrame([("gone", 0.5, 2, 0)], targets.schema))  # a source without documents
    made = X.plan(docs, more)
    with_gone = X.draw(made)
    again = {r.source: r for r in X.share_report(with_gone, more).collect()}
    assert again["gone"].tokens == 0 and again["a"].actual_share == pytest.approx(0.4, abs=0.01)
    margins = X.margin_report(with_gone, made).collect()
    for axis in ("source", "lang", "topic"):
        mine = [r for r in margins if r.axis == axis]
        assert sum(r.actual_share for r in mine) == pytest.approx(1) and sum(r.wanted_share for r in mine) == pytest.approx(1)
        assert all(abs(r.actual_share - r.wanted_share) < 0.06 for r in mine)
    assert [tuple(r) for r in mixed.orderBy("doc_id").limit(50).collect()] == [tuple(r) for r in X.mixture(docs.repartition(7), targets).orderBy("doc_id").limit(50).collect()]


def test_weights_are_inclusion_probabilities(spark):
    docs = spark.createDataFrame([(i, "a", "en", "t", 10 + i % 7) for i in range(400)], "doc_id bigint, source string, lang string, topic string, tokens bigint")
    drawn = [0] * 400
    for seed in range(12):
        for r in X.draw(X.Plan(docs, [("a", "en", "t", 1.3, 1)], {}), seed).collect():
            assert r.copies in (1, 2)
            drawn[r.doc_id] += r.copies
    assert sum(drawn) / 12 == pytest.approx(520, abs=1) and min(drawn) >= 12 and len(set(drawn)) > 5


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mixture_of_the_tables(spark, scale):
    from lexdrift.llm import queries as Q
    from lexdrift.llm.common import table

    d = f"/root/testdata/{scale}"
    mixed = Q.p9_mixture(spark, d).collect()
    caps = {r.source: r for r in table(spark, d, "mix_targets").collect()}
    whole = sum(r.tokens * r.copies for r in mixed)
    there = {r.source for r in table(spark, d, "documents").where("text <> ''").select("source").distinct().collect()} & set(caps)
    assert {r.source for r in mixed} == there and whole > 0
    left = sum(caps[s].target_share for s in there)
    for s in there:
        mine = [r for r in mixed if r.source == s]
        assert max(r.copies for r in mine) <= caps[s].max_repeats
        largest = max(r.tokens for r in mine)
        assert abs(sum(r.tokens * r.copies for r in mine) - caps[s].target_share / left * whole) <= 2 * largest


def _texts(n, languages):
    rng = random.Random(8)
    pools = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(25)] for _ in range(6)]
    rows = []
    for i in range(n):
        a, b = rng.sample(pools, 2)
        left = rng.randint(8, 16) if i % 10 == 0 else 24  # some texts are of two kinds
        rows.append((i, "s", rng.choice(languages), " ".join(rng.choices(a, k=left) + rng.choices(b, k=24 - left))))
    return rows


def _centred(rows):
    """Weighted bags of all texts without the mean of their language."""
    slots = [(np.array(x, np.int64) * 2654435761 >> 7) % X.BAG for x in T.numbers([r[3] for r in rows])]
    x = np.log1p(np.stack([np.bincount(s, minlength=X.BAG) for s in slots]).astype(float))
    x *= np.log((1 + len(rows)) / (1 + (x > 0).sum(0)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    langs = np.array([r[2] or "" for r in rows])
    for lang in set(langs):
        x[langs == lang] -= x[langs == lang].mean(0)
    return x


def _centres(x, topic, n):
    sums = np.stack([x[topic == k].sum(0) for k in range(n)])
    return sums / np.linalg.norm(sums, axis=1, keepdims=True)


def test_topics_are_of_all_documents(spark):
    """Every document is in the topic whose centre, from all documents, is nearest; there are more than were once sampled."""
    rows = _texts(3600, ["en", "de", None])
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    topic_of = {r.doc_id: r.topic for r in X.plan(docs, targets).docs.collect()}
    assert topic_of == {r.doc_id: r.topic for r in X.plan(docs.repartition(7), targets).docs.collect()}
    x, names = _centred(rows), sorted(set(topic_of.values()))
    mine = np.array([names.index(topic_of[i]) for i in range(len(rows))])
    near = x @ _centres(x, mine, len(names)).T
    assert len(names) > 4 and (near.max(1) - near[np.arange(len(rows)), mine]).max() < 1e-3


def test_rounds_with_many_languages(spark):
    rows = _texts(3600, ["en", None, *(f"x{i}" for i in range(600))])
    bags = X.bagged(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")).coalesce(2)
    x = _centred(rows)
    before, after = (X.fit_topics(bags, rounds=n).centres / X.SCALE for n in (0, 1))
    assert np.allclose(after, _centres(x, (x @ before.T).argmax(1), len(before)), atol=1e-4)
