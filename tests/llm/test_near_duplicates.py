import random
import re
from collections import Counter

import pytest

from lexdrift.llm import near_duplicates as N


def _sets(rows, width, least):
    out = {}
    for i, parts in rows:
        w = re.findall(r"[^\W_]+", "\n".join(p for p in parts or [] if p is not None).lower())
        if len(w) >= max(least, width):
            out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return out


def _brute(rows, width, least, threshold):
    s = _sets(rows, width, least)
    ids = sorted(s)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def _rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(15, 120))]
        docs.append((len(docs), [" ".join(base)]))
        for _ in range(rng.randint(0, 3)):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([[], [rng.choice(words)], [edited[k], rng.choice(words)]])
            docs.append((len(docs), [" ".join(edited[:9]), None, " ".join(edited[9:])]))
    return docs


def _frame(spark, rows):
    return spark.createDataFrame([(i, p, 0, 0) for i, p in rows], "row_id bigint, comments array<string>, n int, value int")


def test_pairs_against_brute_force(spark):
    rows = _rows()
    m, links = N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5)
    got = {tuple(r) for r in N.row_pairs(m, links).collect()}
    true = _brute(rows, 3, 20, 0.5)
    assert got <= true
    assert len(got) >= 0.99 * len(true)


@pytest.mark.parametrize("hot", [{"crowd": 1, "block": 1000}, {"crowd": 1, "block": 2}, {"crowd": 2, "often": 2, "tried": 50}])
def test_crowded_postings_lose_nothing(spark, hot):
    rows = _rows()
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(1000 + i, [shared + " " + " ".join(f"o{i}x{j}" for j in range(i))]) for i in range(60)]
    m, links = N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5, **hot)
    got = {tuple(r) for r in N.row_pairs(m, links).collect()}
    true = _brute(rows, 3, 20, 0.5)
    plain = {tuple(r) for r in N.row_pairs(*N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5)).collect()}
    assert got == plain <= true and len(got) >= 0.99 * len(true)
    degree = Counter(x for p in got for x in p)
    assert {r.row_id: r.links for r in N.class_table(m, links).collect()} == {i: degree[i] for i in _sets(rows, 3, 20)}


def test_records_of_a_common_part_never_meet(spark, monkeypatch):
    """A part that all records share, and own words beside it that keep them under the threshold: few pairs are made, none of them in the crowd."""
    shared = " ".join(f"s{i}" for i in range(115))
    rows = [(i, [shared + " " + " ".join(f"o{i}x{j}" for j in range(85))]) for i in range(600)]
    made = {}
    staged = N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: made.setdefault(name, staged(df, name)))
    m, links = N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5, crowd=64)
    assert links.count() == 0 and made["pairs"].count() <= 600 * 64 // 2 and m.count() == 600


def test_groups_are_components(spark):
    rows = _rows()
    m, links = N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in _brute(rows, 3, 20, 0.5):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.row_id: r.group_id for r in N.groups(m, links).collect()}
    assert got == {i: root(i) for i in _sets(rows, 3, 20)}


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, None), (2, []), (3, [None]), (4, [""]), (5, ["too short"]), (6, [text]), (7, [text]), (7, [text]), (8, [" ".join(f"u{i}" for i in range(60_000))])]
    m, links = N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5)
    assert {tuple(r) for r in m.collect()} == {(6, 6), (7, 6), (8, 8)}
    assert {tuple(r) for r in N.row_pairs(m, links).collect()} == {(6, 7)}
    m, links = N.near_duplicates(_frame(spark, rows).limit(0), "row_id", "comments")
    assert m.count() == 0 and N.row_pairs(m, links).count() == 0 and N.groups(m, links).count() == 0


def test_large_class_keeps_the_compact_form(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(i, [text]) for i in range(100)] + [(200, [text + " and one more word here"])]
    m, links = N.near_duplicates(_frame(spark, rows), "row_id", "comments", width=3, least_words=20, threshold=0.5)
    got = {tuple(r) for r in N.row_pairs(m, links, expand=10).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 200)}
    assert len(N.row_pairs(m, links, expand=1000).collect()) == 100 * 99 // 2 + 100
