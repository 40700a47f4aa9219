import duckdb
import numpy as np
import oracle
import pytest

from lexdrift.llm import markup as M
from lexdrift.llm.boosting import BoostedTrees


@pytest.fixture(scope="module")
def pairs():
    con = duckdb.connect()
    read = lambda t: con.execute(f"SELECT a, b FROM (SELECT unnest(raw_comments) a, unnest(comments) b FROM '{oracle.DATA}/sf0.01/{t}.parquet') WHERE a IS NOT NULL").fetchall()
    return read("nulled") + read("silkroad_fts")


@pytest.fixture(scope="module")
def trees(pairs):
    return M.fit(pairs)


def kinds(trees, raw):
    nodes, ks = M._kinds_of(trees, [raw])
    return [M.KINDS[k] for k in ks[0] if k]


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] > 0).astype(int) + 2 * ((x[:, 1] > 0.5) & (x[:, 2] < 0)).astype(int)
    m = BoostedTrees(4, rounds=15).fit(x[:1500], y[:1500])
    assert (m.scores(x[1500:]).argmax(1) == y[1500:]).mean() > 0.95


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<h2>Title</h2>\n<p>text</p><ul><li>one<li>two</ul>", ["heading", "list_item", "list_item"]),
        ("<p>see</p>\n<pre><code># not a heading\n- no item</code></pre>\n<p>x</p>", ["code"]),
        ("# Title of this\n\nsome **bold** text here\n\n- one\n- two\n", ["heading", "list_item", "list_item"]),
        ("Title\n-----\n\nsome **text** here\n\n```\nx = 1\n# y\n```\n", ["heading", "code"]),
        ("== Title ==\nsome ''text'' and [[link]]\n\n# one item, 3 pieces\n# two items, 4 pieces\n", ["heading", "list_item", "list_item"]),
        ("\\section{Title}\nwords \\emph{here}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\[x^2 = 3\\]\n", ["heading", "list_item", "list_item", "formula"]),
        ("some text, so $c_j = \\sqrt{a^2 + 246}$ holds", ["formula"]),
        ("Price is $53 for one and $4980 for the other", []),
        ("", []),
        ("plain words. nothing else", []),
    ],
)
def test_elements(trees, raw, want):
    assert kinds(trees, raw) == want


def test_named_elements_of_unseen_comments(pairs):
    """The kinds of elements that bear their name, and what the flattened text says, hold on comments that were not fitted."""
    half = M.fit(pairs[::2])
    right = total = 0
    for raw, flat in pairs[1::2]:
        nodes, ks = M._kinds_of(half, [raw])
        seen = M.Flat(flat or "")
        for n, k in zip(nodes[0], ks[0]):
            left = seen.allowed(n, raw)
            if n.tag in ("h", "li", "pre", "math") or left == (M.CODE, M.FORMULA):
                total += 1
                right += k in (left or (M.NAMED.get(n.tag),))
    assert total > 300 and right / total > 0.98


def test_kinds_are_learned_not_given(pairs):
    """With the names of the elements taken away the trees have nothing to carry over and give no kinds."""
    named = dict(M.NAMED)
    try:
        M.NAMED.clear()
        blind = M.fit(pairs[:600])
    finally:
        M.NAMED.update(named)
    nodes, ks = M._kinds_of(blind, ["# Title here\n\n- one\n- two\n"])
    assert M.HEADING not in ks[0] or M.ITEM not in ks[0]


@pytest.mark.parametrize("piece", ["```x\n", "\\begin{verbatim}", "\\[", "$$", "<span class='tex'>", "~~~~ a\n", "<pre>"])
def test_unclosed_regions_take_linear_time(piece):
    import time

    began = time.time()
    M.parse(piece * 20_000)
    assert time.time() - began < 10


def test_clean_text_loses_no_letters(pairs, trees):
    letters = lambda t: "".join(filter(str.isalpha, t))
    for raw in ("Use <code>foo_bar</code> in the text now", "a <span class='tex'>x</span> b", "see <syntaxhighlight>y z</syntaxhighlight> there", "<listing>q</listing>", "\\begin{verbatim}z\\end{verbatim}"):
        nodes, ks = M._kinds_of(trees, [raw])
        text = M.render(raw, nodes[0], ks[0])
        inner = M._plain(M._CODE_SHELL.sub("", M._MATH_SHELL.sub("", raw)), True)
        assert letters(text) == letters(inner)
    same = total = 0
    for raw, flat in pairs[:1200]:
        if flat is None:
            continue
        nodes, ks = M._kinds_of(trees, [raw])
        kept = [M.OTHER if k in (M.CODE, M.FORMULA) else k for k in ks[0]]
        drop = {i for i, k in enumerate(ks[0]) if k in (M.CODE, M.FORMULA)}
        text = M.render(raw, [n for i, n in enumerate(nodes[0]) if i not in drop], [k for i, k in enumerate(kept) if i not in drop])
        total += 1
        same += letters(text) == letters(flat)
    assert same / total > 0.97


def test_clean_text_keeps_structure(trees):
    raw = "# Title\n\nsome **bold** text\n\n- one\n- two\n\n```\nx = 1\n```\n\nso $c_j = \\sqrt{a^2}$ holds"
    nodes, ks = M._kinds_of(trees, [raw])
    assert M.render(raw, nodes[0], ks[0]) == "# Title\nsome bold text\n- one\n- two\n```\nx = 1\n```\nso $c_j = \\sqrt{a^2}$ holds"


def test_edges(spark, trees):
    rows = [("t", 1, None, 0), ("t", 2, [None, "", "<", "<<<>>", "<li", "$" * 5000], 0), ("t", 3, ["<h1>a</h1>" * 3000], 0), ("t", 3, ["<h1>a</h1>" * 3000], 0)]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, raw_comments array<string>, nth int")
    got = M.elements(df, trees).groupBy("row_id", "kind").count().collect()
    assert {(r.row_id, r.kind, r["count"]) for r in got} >= {(3, "heading", 6000)}
    assert M.clean(df, trees).count() == 4
    assert M.elements(df.limit(0), trees).count() == 0
    assert M.fit([]).scores(M.design([[0.0] * len(M.FEATURES)])).shape == (1, 5)
