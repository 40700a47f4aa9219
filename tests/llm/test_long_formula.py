import time

from lexdrift.llm import markup as M


def test_an_inline_formula_may_be_of_any_length():
    long = "x_1 + " * 200 + "y"
    for text in (f"so ${long}$ holds", "so $x$ holds"):
        assert [m.group().count("$") for m in M._REGION.finditer(text) if m.group("inline")] == [2]
    assert not [m for m in M._REGION.finditer(f"so ${long}\n{long}$ holds") if m.group("inline")]


def test_many_single_dollars_take_little_time():
    began = time.time()
    list(M._REGION.finditer("a $b " * 50_000))
    list(M._REGION.finditer("$" + "b " * 100_000))
    assert time.time() - began < 5


def test_the_whole_text_of_a_node_is_compared():
    raw = "so $\\alpha = " + "same words " * 8 + "one$ holds"
    node = next(n for n in M.parse(raw) if n.tag == "inline")
    assert M.Flat(raw).allowed(node, raw) == (M.OTHER,)
    assert M.Flat(raw.replace("one", "two")).allowed(node, raw) == (M.CODE, M.FORMULA)
