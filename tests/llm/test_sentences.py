import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexdrift.llm import sentences as S


@pytest.mark.parametrize(
    "text, parts",
    [
        ("One. Two!", ["One.", "Two!"]),
        ("Sold 12.5 kg, i.e. more. Then he left.", ["Sold 12.5 kg, i.e. more.", "Then he left."]),
        ("Dr. Smith of Foo Inc. and Bar Ltd. came at 5 p.m. by car.", ["Dr. Smith of Foo Inc. and Bar Ltd. came at 5 p.m. by car."]),
        ("He came at 7 p.m. Nobody saw.", ["He came at 7 p.m.", "Nobody saw."]),
        ('He said "it is dusty. trust me." and left. Gone.', ['He said "it is dusty. trust me." and left.', "Gone."]),
        ('"It is cheap." That is all.', ['"It is cheap."', "That is all."]),
        ('"Is it new?" asked bob. Yes.', ['"Is it new?" asked bob.', "Yes."]),
        ("(The box was lost.) Now it works.", ["(The box was lost.)", "Now it works."]),
        ("Wait (did you ask? I doubt it) before noon. ok", ["Wait (did you ask? I doubt it) before noon.", "ok"]),
        ("It costs 5 coins... maybe more. It broke... Then it worked.", ["It costs 5 coins... maybe more.", "It broke...", "Then it worked."]),
        ("It held up. :) Next one.", ["It held up. :)", "Next one."]),
        ("Works again.Thanks for that, bob.", ["Works again.", "Thanks for that, bob."]),
        ("See core.exe and v1.2.3 at http://a.test/x.html?id=4 now", ["See core.exe and v1.2.3 at http://a.test/x.html?id=4 now"]),
        ("Die Lieferung kam am 10. Mai, z. B. mit Kanal. Nr. 4 fehlt.", ["Die Lieferung kam am 10. Mai, z. B. mit Kanal.", "Nr. 4 fehlt."]),
        ("В 2016 г. он продал ключ и т. д. для Xolit. Цена ок. 5 монет.", ["В 2016 г. он продал ключ и т. д. для Xolit.", "Цена ок. 5 монет."]),
        ("«Где мой ключ?» — спросил bob. Да.", ["«Где мой ключ?» — спросил bob.", "Да."]),
        ("« C'est prêt ! » a écrit bob. M. le chef dort.", ["« C'est prêt ! » a écrit bob.", "M. le chef dort."]),
        ("¿Está bien? ¡Sí! Vale.", ["¿Está bien?", "¡Sí!", "Vale."]),
        ("価格は安い！次は？はい。", ["価格は安い！", "次は？", "はい。"]),
        ("「安い。本当だ！」と言って、送りました。次。", ["「安い。本当だ！」と言って、送りました。", "次。"]),
        ("他说：“很好。真的！”然后走了……好", ["他说：“很好。真的！”然后走了……", "好"]),
        ("एक बात। दो बात?", ["एक बात।", "दो बात?"]),
        ("ผมส่งแล้วครับ ใครซื้อ X บ้างคะ ดี", ["ผมส่งแล้วครับ", "ใครซื้อ X บ้างคะ", "ดี"]),
        ("قال: «جيد.» ثم ذهب. هل جئت؟ نعم", ["قال: «جيد.» ثم ذهب.", "هل جئت؟", "نعم"]),
        ("请联系R. Haskalde，电话555。价格是5元", ["请联系R. Haskalde，电话555。", "价格是5元"]),
        ("my number is 311 555 0149 ext. 26, text only", ["my number is 311 555 0149 ext. 26, text only"]),
        ("one\n\n  two \n", ["one", "two"]),
    ],
)
def test_rules(text, parts):
    assert S.split_sentences(text) == parts


@given(st.text(alphabet="aB .!?\n\"'()«»。「」:)1", max_size=60))
def test_every_visible_character_is_in_one_sentence(text):
    starts = S.sentence_starts(text)
    assert starts == sorted(set(starts))
    assert all(not text[s].isspace() for s in starts)
    lines, at = 0, 0
    for line in text.split("\n"):
        if line.strip():
            first = at + len(line) - len(line.lstrip())
            assert first in starts
            lines += 1
        at += len(line) + 1
    assert len(starts) >= lines


MARKS = ".!?…。！？।؟︒｡\"'’”“»«„‚‘「」『』()[]¿¡:;)-—,، "
LETTERS = "aBéßÑжЯبم한가日本かカहिสวค19"


@given(st.text(alphabet=MARKS + LETTERS, max_size=80))
def test_any_script_with_any_marks(text):
    starts = S.sentence_starts(text)
    assert starts == sorted(set(starts)) and all(not text[s].isspace() for s in starts)
    assert "".join("".join(S.split_sentences(text)).split()) == "".join(text.split())


@pytest.mark.parametrize("text, n", [("مرحبا بكم.» كيف حالك اليوم.", 2), ("สวัสดี.) ทดสอบ.", 2), ("यह ठीक है।) फिर मिलेंगे।", 2), ("ok.) Next.", 2), ("好。」下一个。", 1)])
def test_closing_marks_without_opening_ones(text, n):
    assert len(S.sentence_starts(text)) == n


@pytest.mark.parametrize(
    "line, language",
    [("Das ist nicht neu.", "de"), ("Le prix est bon.", "fr"), ("El precio es bueno.", "es"), ("The price is good.", "en"), ("Xolit 45.", "latin"), ("価格は安い", "ja"), ("价格很低", "zh"), ("цена", "ru"), ("قال", "ar"), ("एक", "hi"), ("ผม", "th")],
)
def test_language_of(line, language):
    assert S.language_of(line) == language


def test_rules_see_as_far_back_as_they_need():
    assert S.split_sentences("x (" + "word " * 5000 + "end. More) goes on. Next.")[-1] == "Next."
    long = "A" + "b" * 3000
    assert S.split_sentences(f"Stop {long}.Again now.") == [f"Stop {long}.", "Again now."]


@pytest.mark.parametrize("piece", ["(", "«", '"', "A. ", "' ", "„", "(a. ", ":( ", "1. ", "…", "ครับ "])
def test_long_lines_take_linear_time(piece):
    import time

    began = time.time()
    S.sentence_starts("a. " + piece * 60_000)
    assert time.time() - began < 10


def test_edges(spark):
    rows = [("t", 1, None, 0), ("t", 2, [None, "", " \n "], 0), ("t", 3, ["A. B. " * 20_000], 0), ("t", 3, ["A. B. " * 20_000], 0)]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, comments array<string>, start_pos int")
    assert S.sentences(df).select("row_id").distinct().collect()[0][0] == 3
    assert S.sentences(df.limit(0)).count() == 0
    assert S.sentences(df, with_text=True).columns == ["tbl", "row_id", "comment_ix", "start_pos", "sentence"]
