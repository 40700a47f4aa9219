"""Small cases with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.functions import text as T
from lexdrift.functions import vector as V
from lexdrift.operators import evaluation as E
from lexdrift.operators import models as M
from lexdrift.operators import parsing as H
from lexdrift.operators import phrases as P
from lexdrift.operators import threads as O
from lexdrift.operators import training as TR
from lexdrift.operators import vectors as X
from lexdrift.operators import vocabulary as W
from lexdrift.plans import commands


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


def test_cut_between_markers(spark):
    assert one(spark, T.cut_between(F.col("t"), "begin pgp message", " end pgp message"), t=" a begin pgp message X end pgp message b") == " a   b"
    assert one(spark, T.cut_between(F.col("t"), "<a>", "<b>"), t="x<a>open") == "x open"


def test_token_recipe(spark):
    got = one(spark, T.sentence_tokens(F.array(F.col("t"))), t="Café-Au-lait 2019 -5- the -the-")
    assert got == [[["cafe-au-lait", "5", "the"]]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("see http://ex.org/a1 now", "see URL__TOKEN  now"), ("see http://ex.org/ now", "see URL__TOKEN now"), ("at http://1.2.3.4/x", "at URL__TOKEN "), ("http://ex.org/a1, ok", "URL__TOKEN , ok"),
        ("me@x.org", "EMAIL__TOKEN "), ("9f8e7d6c5b4a39281706f5e4d3c2b1a0 x", "HASH__TOKEN  x"),
    ],
)
def test_masks(spark, text, want):
    assert one(spark, T.mask(F.col("t")), t=text) == want


def _lines(spark, lines):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(lines)], "line_id bigint, tokens array<string>")


def test_two_corpus_vocabulary(spark):
    tokens = spark.createDataFrame([("good", w) for w in "aba"] + [("bad", w) for w in "bc"], "corpus string, word string")
    lines = spark.createDataFrame([("good",), ("bad",)], "corpus string")
    counts = W.two_corpus_counts(tokens, lines)
    assert [tuple(r) for r in W.indexed(counts, 1).orderBy("idx").collect()] == [(0, "</s>", 2, 1, 1), (1, "a", 2, 2, 0), (2, "b", 2, 1, 1), (3, "c", 1, 0, 1)]
    assert [r.word for r in W.indexed(counts, 2).orderBy("idx").collect()] == ["</s>", "a", "b"]
    assert {r.word for r in W.common(counts).collect()} == {"</s>", "b"}


def test_cooccurrence_drops_unknown_words_first(spark):
    got = P.cooccurrences(_lines(spark, ["a b x c"]), spark.createDataFrame([("a",), ("b",), ("c",)], "word string"), 1)
    assert {tuple(r) for r in got.collect()} == {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "b", 1)}


def test_softmax(spark):
    for clamp, want in ((True, [0.006648, 0.986703, 0.006648, 0.0]), (False, [0.000803, 0.119107, 0.880090, 0.000001])):
        q = spark.createDataFrame([(1, [1.0])], "qid bigint, vec array<double>")
        rows = spark.createDataFrame([(i, [d]) for i, d in enumerate([0.0, 5.0, 7.0, -7.0])], "idx bigint, vec array<double>")
        got = {r.idx: r.p for r in X.predictions(q, rows, 4, clamp).collect()}
        assert [round(got[i], 6) for i in range(4)] == want


def test_distances(spark):
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    val = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert val(V.cosine_distance(a(1, 0), a(1, 1))) == pytest.approx(0.292893, abs=1e-6) and val(V.l1(a(1, 0), a(1, 1))) == 1
    assert val(V.bhattacharyya(a(1, 1), a(1, 3))) == pytest.approx(0.015056, abs=1e-6)
    assert val(V.bhattacharyya_observed(a(0.5, 0.5), a(1, 3))) == pytest.approx(0.034668, abs=1e-6)
    assert val(V.jaccard(a(1, 2, 3), a(2, 3, 4))) == 0.5
    assert val(V.cosine(a(0, 0), a(1, 1))) is None and val(V.bhattacharyya_observed(a(1, 0), a(0, 0))) is None
    assert val(W.keep_probability(F.lit(100), F.lit(10_000), 1e-3)) == pytest.approx(0.416228, abs=1e-6)


def test_phrases(spark):
    words = _lines(spark, ["w1 w2 w3 w4", "", "w4 w1"])
    scored = spark.createDataFrame([(f"w{i}", f"w{i + 1}", 200.0) for i in (1, 2, 3)], "a string, b string, score double")
    assert {tuple(r) for r in P.merge(words, scored, 100).collect()} == {(0, "w1_w2 w3_w4"), (2, "w4 w1")}
    crossing = {(r.a, r.b): r.n for r in P.bigrams(words).collect()}
    assert crossing["w4", "w4"] == 1 and ("w4", "w4") not in {(r.a, r.b) for r in P.bigrams(words, False).collect()}
    text = ["a b"] * 20 + ["a x"] * 10 + ["b y"] * 20
    want = (20 - 5) / 30 / 40 * 100
    assert {(r.a, r.b): r.score for r in P.scores(_lines(spark, text), 5, False).collect()}["a", "b"] == pytest.approx(want)


def test_aligned_lines(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "c"]), (1, 2, ["b"]), (2, 0, ["c"])], "thread bigint, at int, tokens array<string>")
    got = W.aligned_lines(s, spark.createDataFrame([("a",), ("b",)], "word string")).collect()
    assert [tuple(r) for r in got] == [(1, "a b b")]


def test_annotation_spans(spark):
    spans = spark.createDataFrame([("f", "1", 4, 13, "t")], "forum string, code string, start int, end_pos int, tagger string")
    texts = spark.createDataFrame([("f", "1", None, "See Bot-Net x")], "forum string, code string, type string, text string")
    marks = E.annotation_tokens(spans, texts)
    assert [tuple(r) for r in marks.collect()] == [("bot-net", "f", None, "t")]
    assert E.labels(marks).first().label == "f None"


def test_neighbours_leave_out_the_query_words(spark):
    rows = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(10)], "idx bigint, vec array<double>")
    terms = spark.createDataFrame([(1, 2), (1, 4), (2, 3), (2, 99)], "qid bigint, idx bigint")
    got = X.top_products(X.phrase_queries(terms, rows), rows, 3).orderBy("rank").collect()
    assert [(r.qid, r.idx) for r in got] == [(1, 3), (1, 1), (1, 5)]


def test_analogy_takes_positive_scores_of_other_words(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-0.6, 0.8]), (4, [0.6, 0.8])], "idx bigint, vec array<double>")
    q = spark.createDataFrame([(7, 0, 1, 2), (8, 0, 1, 99)], "qid bigint, a bigint, b bigint, c bigint")
    assert [(r.qid, r.idx) for r in X.analogies(q, rows, 5).orderBy("rank").collect()] == [(7, 3), (7, 4)]


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "idx bigint, vec array<double>")
    q = rows.where("idx < 10").select(F.col("idx").alias("qid"), "vec", F.array("idx").alias("skip"))
    a = {tuple(r) for r in X.top_products(q, rows, 5).collect()}
    assert a == {tuple(r) for r in X.top_products(q, rows, 5, query_block=3, row_block=7).collect()}
    for i in range(10):
        s = np.round(m @ m[i], 6)
        s[i] = -9
        assert {r[1] for r in a if r[0] == i} == set(sorted(range(60), key=lambda j: (-s[j], j))[:5])


def test_dated_threads_need_more_than_three_tokens(spark):
    tokens = spark.createDataFrame([("a", w) for w in "xyz"] + [("b", w) for w in "wxyzz"] + [("c", w) for w in "wxyz"], "thread string, token string")
    dates = spark.createDataFrame([("a", 1), ("b", 5), ("b", 3), ("c", None)], "thread string, ts bigint")
    got = E.dated_tokens(tokens, dates).collect()
    assert {(r.token, r.thread, r.start_date, r.end_date) for r in got} == {(w, "b", 3, 5) for w in "wxyz"}


def test_assembly_and_upsert(spark):
    posts = spark.createDataFrame([("t", 2, "B", "two"), ("t", 1, None, None), ("t", 3, "", "x"), ("t", 3, "b", "a"), (None, 1, "q", "q")], "thread_id string, seq bigint, author string, body string")
    r = O.assemble(posts).collect()
    assert [(x.thread_id, x.comments, x.authors) for x in r] == [("t", ["", "two", "a", "x"], ["b"])]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "lost")], "k string, at int, v string")
    assert [x.v for x in O.upsert(rows, "k", F.col("at")).collect()] == ["new"]
    titles = spark.createDataFrame([("t", "T"), ("u", "U")], "thread_id string, title string")
    assert O.with_titles(O.assemble(posts), titles).count() == 2 and O.with_titles(O.assemble(posts), titles, keep_title_only=False).count() == 1


BOARD = """<html><script>x()</script><div id="content"><div class="navigation"><a>1</a><a>2</a><a>3</a><span>Title &amp; more</span></div><div id="posts">
<table class="tborder"><tr><td class="tcat"><div class="float_left smalltext">03-11-2024, 09:15 PM
 x</div></td><td class="post_author"><span class="largetext">Bob</span></td><td><div class="post_body">one <code>no</code><b>two</b></div></td></tr></table>
<table class="tborder"><tr><td class="tcat"><div class="float_left smalltext">Yesterday</div></td><td><div class="post_body">three<br>four</div></td></tr></table></div></div>"""
MARKET = """<div id="main_content_section"><div class="navigate_section">Home » Drugs » Here</div><div id="forumposts"><div class="cat_bar"> Topic: Good stuff  (Read 12 times)</div>
<form id="quickModForm" action="http://m/1"><div><div class="poster"><h4>Al</h4></div><div class="flow_hidden"><div class="smalltext">« <strong>on:</strong> March 11, 2024, 09:15 PM »</div></div><div class="post">hello <i>you</i></div></div></form></div></div>"""
LINKS = """<div class="side"><div class="usertext-body">side</div></div><a class="title may-blank">A title</a><div class="md usertext-body"><p>first</p></div><div class="usertext-body">[deleted]</div>"""


def test_parsers(spark):
    pages = lambda html: spark.createDataFrame([("1", html), ("2", "<p>other</p>"), ("3", None), ("4", "")], "id string, html string")
    got = H.parse_pages(pages(BOARD), "board").collect()
    assert [(r.id, r.title, r.authors, r.comments) for r in got] == [("1", "Title & more", ["Bob"], ["one  two", "three four"])]
    dated = H.parse_pages(pages(BOARD), "board", dated=True).collect()
    assert len(dated) == 1 and dated[0].comments == ["one  two"] and str(dated[0].dates[0]) == "2024-03-11 21:15:00"
    m = H.parse_page(MARKET, "market", dated=True)
    assert (m["title"], m["url"], m["category"], m["authors"], m["dates"]) == ("Good stuff", "http://m/1", ["Home", "Drugs"], ["Al"], ["March 11, 2024, 09:15 PM"])
    links = H.parse_pages(pages(LINKS), "links").collect()
    assert [(r.title, r.comments) for r in links] == [("A title", ["first"])]
    assert H.page_text(None) is None and H.page_text("<pre>a</pre>b") == "a b"


def test_prose_drops_code_and_short_comments(spark):
    code = "f(x);" * 60
    rows = spark.createDataFrame([(["a", "b", "short", "long enough to be kept here", code, None],)], "c array<string>")
    assert rows.select(T.prose(F.col("c"))).first()[0] == "a.\n\nb.\n\nlong enough to be kept here"


def test_huffman_is_optimal_and_prefix_free():
    counts = [("a", 45), ("b", 16), ("c", 13), ("d", 12), ("e", 9), ("f", 5)]
    codes = W.huffman(counts)
    assert sum(len(c) * n for (_, c, _), (_, n) in zip(codes, counts)) == 224
    words = [c for _, c, _ in codes]
    assert not any(x != y and y.startswith(x) for x in words for y in words)
    assert all(len(c) == len(p) and (not p or p[0] == len(counts) - 2) for _, c, p in codes)
    assert W.huffman([("a", 1)]) == [("a", "", [])] and W.huffman([]) == []


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 5)) * rng.uniform(0.5, 3, size=(90, 1))
    cls = np.arange(90) % 6
    for _ in range(10):
        c = np.array([m[cls == k].sum(0) for k in range(6)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
        cls = (m @ c.T).argmax(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "idx bigint, vec array<double>").repartition(3)
    got = {r.idx: r["class"] for r in M.spherical_kmeans(rows, 6).collect()}
    assert [got[i] for i in range(90)] == cls.tolist()
    assert M.spherical_kmeans(rows.limit(0), 6).count() == 0


def test_linear_map_recovers_the_matrix(spark):
    rng = np.random.default_rng(4)
    w, x = rng.normal(size=(3, 3)), rng.normal(size=(100, 3))
    rows = [(int(i % 2), bool(i % 5 == 0), v.tolist(), (w @ v).tolist()) for i, v in enumerate(x)]
    got = M.linear_maps(spark.createDataFrame(rows, "cluster bigint, heldout boolean, x array<double>, y array<double>")).collect()
    assert len(got) == 2 and all(np.allclose(np.array(r.w).reshape(3, 3), w, atol=1e-4) and abs(r.heldout_loss) < 1e-6 and abs(r.inverse_loss) < 1e-4 for r in got)


def test_training_separates_and_shift_is_found(spark):
    """Words that keep their company stay alike in both corpora; an injected word does not."""
    rng = np.random.default_rng(5)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(4)]
    lines = [(c, i * 2 + (c == "bad"), [str(w) for w in rng.choice(topics[i % 4], 12)]) for i in range(400) for c in ("good", "bad")]
    lines = [(c, i, ["t3w0" if c == "bad" and w == "t0w0" else "t0w0" if c == "bad" and w == "t3w0" else w for w in t]) for c, i, t in lines]
    df = spark.createDataFrame(lines, "corpus string, line_id bigint, tokens array<string>")
    vocab = commands.vocab(df, 5).where("word <> '</s>'").withColumn("idx", F.col("idx") - 1)
    options = dict(dim=16, epochs=6, window=4, negative=5, sample=0.0, alpha=0.2)
    for how in ("cotrain",):
        sims = {r.word: r.sim for r in X.cross_model(commands.train(df, vocab, how, **options)).collect()}
        lowest = sorted(sims, key=sims.get)[:4]
        assert {"t0w0", "t3w0"} <= set(lowest)
        assert np.median(list(sims.values())) > 0.8


@pytest.mark.parametrize("how", [{"cbow": True}, {"hierarchical": True, "negative": 0}, {}])
def test_training_lowers_its_loss(spark, how):
    rng = np.random.default_rng(6)
    rows = [(0, i, [int(x) for x in rng.integers(0, 10, 15) + 10 * (i % 3)]) for i in range(300)]
    encoded = spark.createDataFrame(rows, "corpus int, line_id bigint, ids array<bigint>")
    vocab = spark.createDataFrame([(i, f"w{i}", 150) for i in range(30)], "idx bigint, word string, cn bigint")
    w, _, losses = TR.train(encoded, vocab, TR.Options(dim=12, epochs=6, sample=0.0, alpha=0.3, batch=32, **how), 1)
    assert losses[-1] < losses[0]
    u = w[0] / np.linalg.norm(w[0], axis=1, keepdims=True)
    s = u @ u.T
    same = np.mean([s[i, j] for i in range(30) for j in range(i) if i // 10 == j // 10])
    other = np.mean([s[i, j] for i in range(30) for j in range(i) if i // 10 != j // 10])
    assert same > other + 0.2


def test_p_values():
    assert E._p_value(0.5, 20) == pytest.approx(0.024770, abs=1e-5)
    assert E._p_value(0.0, 20) == pytest.approx(1.0) and E._p_value(1.0, 5) == 0.0 and E._p_value(0.3, 2) is None


def test_commands(spark):
    assert set(commands.COMMANDS) >= {"preprocess", "prepare", "train", "coverage", "eval_stats", "gettime", "simulate"}
    with pytest.raises(ValueError):
        commands.run("nothing")
    dark = spark.createDataFrame([("f", 1, ["alpha beta. gamma only"]), ("f", 2, ["gamma only"])], "forum string, row_id bigint, comments array<string>")
    white = spark.createDataFrame([("g", 1, ["alpha beta delta"])], "forum string, row_id bigint, comments array<string>")
    got = commands.run("prepare", dark, white)
    assert [tuple(r) for r in got["dark"].collect()] == [("f", 1, "alpha beta")] and got["white"].count() == 0
    pages = commands.run("preprocess", spark.createDataFrame([("1", BOARD)], "id string, html string"), "board")
    assert pages.first().texts == "title one two three four"
