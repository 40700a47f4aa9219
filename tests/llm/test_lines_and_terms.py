import random
from collections import Counter

from lexdrift.llm import repeated_lines as R
from lexdrift.llm import term_counts as C


def test_repeated_lines(spark):
    rows = [("a", i, ["Share this!\nrow %s" % chr(97 + i), None], 1) for i in range(5)] + [("a", 9, None, 1), ("a", 10, ["", "\n", "123\nSHARE   THIS"], 1)]
    rows += [("b", i, ["share this"], 1) for i in range(3)] + [(None, i, ["share this"], 1) for i in range(4)]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, comments array<string>, h int")
    got = {tuple(r) for r in R.repeated_line_occurrences(df).collect()}
    assert got == {("a", i, 0, 0) for i in range(5)} | {("a", 10, 2, 1)} | {(None, i, 0, 0) for i in range(4)}
    clean = {(r.tbl, r.row_id): r.comments for r in R.without_repeated_lines(df).collect()}
    assert clean["a", 0] == ["row a", None] and clean["a", 9] is None and clean["a", 10] == ["", "\n", "123"] and clean["b", 0] == ["share this"] and clean[None, 1] == [""]
    assert len(clean) == len(rows)
    # more frequent lines than may be sent to every task: the same by way of a join
    assert {tuple(r) for r in R.repeated_line_occurrences(df, sent_at_most=0).collect()} == got
    twice = df.union(df.where("row_id = 10"))
    again = [((r.tbl, r.row_id), r.comments) for r in R.without_repeated_lines(twice, sent_at_most=0).collect()]
    assert dict(again) == clean and len(again) == len(rows) + 1
    assert R.repeated_line_occurrences(df.limit(0)).count() == 0 and R.without_repeated_lines(df.limit(0)).count() == 0


def test_share_counts_rows_not_occurrences(spark):
    df = spark.createDataFrame([("a", 1, ["x\nx\nx\nx"]), ("a", 2, ["x"])], "tbl string, row_id bigint, comments array<string>")
    assert R.frequent_lines(df, min_rows=3).count() == 0
    assert [tuple(r)[2] for r in R.frequent_lines(df, min_rows=2).collect()] == [2]


def test_burst_trie():
    t = C.BurstTrie(burst=4)
    rng = random.Random(1)
    true = Counter()
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        t.add([w], [2], [1])
        true[w] += 1
    got = {}
    for path, held in t.containers():
        for w, (o, r) in held.items():
            assert w.startswith(path) and w not in got
            got[w] = (o, r)
    assert got == {w: (2 * n, n) for w, n in true.items()} and t.terms == len(true)


def test_term_counts_with_small_tries(spark):
    rng = random.Random(2)
    texts = [None, "", " \t ", "a a  b\tb", "x" * 100_000] + [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(20)) for _ in range(300)]
    df = spark.createDataFrame([(t, 1) for t in texts], "texts string, n int").repartition(4)
    occ, recs = Counter(), Counter()
    for t in texts:
        w = (t or "").replace("\t", " ").split(" ")
        occ.update(x for x in w if x)
        recs.update({x for x in w if x})
    for burst, flush, depth in ((3, 20, 2), (2048, 400_000, 24)):
        got = {r.term: (r.occ, r.recs) for r in C.term_counts(df, "texts", burst, flush, depth).collect()}
        assert got == {w: (occ[w], recs[w]) for w in occ}
    assert C.term_counts(df.limit(0), "texts").count() == 0


def test_heavy_paths_are_cut(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_ROUTE", 10)
    words = [f"http://site/{i:04d}" for i in range(2000)]
    df = spark.createDataFrame([(" ".join(words[i::7]),) for i in range(7)], "texts string").repartition(3)
    assert {r.term: r.recs for r in C.term_counts(df, "texts", burst=16).collect()} == dict.fromkeys(words, 1)


def test_long_common_beginnings_are_cut(spark, monkeypatch):
    """Terms that share far more characters than one step of depth still go different ways."""
    monkeypatch.setattr(C, "LEAST_ROUTE", 10)
    words = ["http://" + "a" * 100 + f"/{i:04d}" for i in range(1500)]
    df = spark.createDataFrame([(" ".join(words[i::5]),) for i in range(5)], "texts string").repartition(3)
    seen = {}
    routed = C._routed
    monkeypatch.setattr(C, "_routed", lambda heavy: seen.setdefault("heavy", heavy) and routed(heavy))
    assert {r.term: r.recs for r in C.term_counts(df, "texts", burst=16, depth=8).collect()} == dict.fromkeys(words, 1)
    assert max(map(len, seen["heavy"])) >= 108 and len({C._route(w, seen["heavy"]) for w in words}) >= 10


def test_weighted_counts(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), ("a", 3), (None, 9), ("b", None)], "word string, cn bigint")
    assert {tuple(r) for r in C.weighted_counts(df, "word", "cn").collect()} == {("a", 6, 3), ("b", 0, 1)}
    assert C.weighted_counts(df.limit(0), "word", "cn").count() == 0
