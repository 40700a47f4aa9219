"""Sentence boundaries across languages and scripts: cascading tables of break and no-break rules.

Each line is searched for places where a sentence may end: a group of end marks with the closing marks and
smileys that belong to it, or a sentence-final particle before a blank in a script that writes no end marks.
At every place the rules of the language are tried in order, then those of its script, then those common to
all. A rule is a decision and a pair of patterns, for what stands before the place (up to and with the end
marks, however far back) and what stands after it, and may be limited to some situations of the place; the first
rule whose situation and patterns fit decides. Nothing else decides.

The situation is a letter, found by one pass over the quotation marks and brackets of the line:

    o  nothing but blanks or text follows the end marks      n  within quotes or brackets that end later
    c  closing marks without opening ones follow             f  at the end of quotes or brackets that open the sentence
    s  only smileys follow                                   m  at the end of quotes or brackets within the sentence

Ends within quotes (n) are decided once the quotes end: if those are a sentence of their own, the rules of
``WITHIN`` say which of the ends inside count.

The language is guessed per line: by script, Chinese and Japanese by kana, and English, German, French and
Spanish by their commonest words; a Latin line without any of them is tried with the rules of all four.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER = r"A-ZÀ-ÖØ-ÞА-ЯЁ"
LOWER = r"a-zß-öø-ÿа-яё"
OPEN = "\"'«„“‚‘「『(\\[¿¡"
CLOSE = "\"'’”“»)\\]」』"
WIDE = "。！？｡︒…"
BREAK, KEEP = True, False

# Abbreviations that never end a sentence, and those that do before a capital.
NEVER = {
    "en": "Dept approx ext vs e.g i.e vol sec ver fig Fig art Art cf env Rev Gen Capt Lt Jr St Acc al.e".split(),
    "de": "Abt Acc Nr Tel ca bzw inkl zzgl vgl Str Hr Fr".split(),
    "fr": "env tél tel Tel cf ca".split(),
    "es": "núm pág p.ej Srta aprox ul".split(),
    "ru": "т ок тел ул стр рис см напр руб им гр проф т.е".split(),
    "hi": "नं रु डॉ श्री क्र".split(),
    "ar": "د أ م ص".split(),
    "th": "นาย ดร พ.ศ น ต".split(),
    "all": "Mr Mrs Ms Dr Prof Sr Sra ext ul tel Tel".split(),
}
MAYBE = {
    "en": "Inc Ltd Co Corp etc al p.m a.m U.S U.K Rd Ave Bros".split(),
    "de": "usw etc".split(),
    "fr": "etc al".split(),
    "es": "etc ca.o".split(),
    "ru": "г д п р др пр е гг в вв".split(),
    "all": "Inc Ltd Co Corp".split(),
}
COMMON_WORDS = {
    "en": "the a an is was and of to you it that this for with in on my your are were be by as not or if so has have at who no".split(),
    "de": "der die das und ist nicht ein eine einen den dem mit für von hat wurde zu als im am auf bitte sich des war wer wo".split(),
    "fr": "le la les et est une un des du pour pas que qui dans sur avec ce il elle je vous au sa son a été".split(),
    "es": "el la los las y es una un de que en por para con su se del al no mi lo fue ha este esta".split(),
}
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
PARTICLES = "ครับผม|ครับ|ค่ะ|คะ|จ้ะ|จ้า"


def _words(words: list[str]) -> str:
    return r"(?<![\w.])(?:%s)\." % "|".join(sorted((re.escape(w) for w in words), key=len, reverse=True))


def _abbreviations(language: str) -> list[tuple]:
    never, maybe = NEVER.get(language), MAYBE.get(language)
    return ([(KEEP, "", _words(never), "")] if never else []) + ([(KEEP, "", _words(maybe), rf"\s*(?:[^\s{UPPER}{OPEN}]|$)")] if maybe else [])


# Rules (decision, situations or "" for any, before, after). Before ends at the place, after begins behind its closing marks.
INITIAL = rf"(?<![A-Za-zÀ-ÿА-яЁё0-9.'’])[{UPPER}]\."
LATIN = [(KEEP, "", r"(?<!\w)(?i:no|nos|nr|p|pp|ch|pt)\.", r"\s*\d"), (KEEP, "", r"^\s*\d{1,3}\.", ""), (KEEP, "", INITIAL, "")]
NO_OPENING = [(KEEP, "m", "", "")]  # scripts without capitals: what follows a quotation within a sentence belongs to it
RULES: dict[str, list[tuple]] = {
    "en": _abbreviations("en"),
    "de": [
        *_abbreviations("de"), (KEEP, "", r"(?<!\w)(?:d|z|u|o|i|s)\. ?(?:h|B|a|ä|d|R|o)\.", ""), (KEEP, "", r"(?<!\w)(?:d|z|u)\.", r"\s*[hBaä]\."),
        (KEEP, "", r"(?<!\d)\d{1,2}\.", rf"\s*(?:{MONTHS})(?!\w)"),
    ],
    "fr": _abbreviations("fr"),
    "es": _abbreviations("es"),
    "ru": _abbreviations("ru"),
    "hi": [*NO_OPENING, *_abbreviations("hi")],
    "ar": [(KEEP, "fmc", "", r"\s+[،؛]"), *NO_OPENING, *_abbreviations("ar")],
    "th": [(BREAK, "os", rf"(?:{PARTICLES})", r"\s"), *NO_OPENING, *_abbreviations("th")],
    "zh": [(KEEP, "fmc", rf"[{WIDE}][.!?{WIDE}]*", rf"[^\s{OPEN}]")],  # “…。”然后: the outer sentence goes on
    "ja": [(KEEP, "fmc", rf"[{WIDE}][.!?{WIDE}]*", rf"[^\s{OPEN}]")],  # 「…。」と
    "all": [
        *_abbreviations("all"),
        (KEEP, "", INITIAL, rf"\s*[{UPPER}]"),
        (KEEP, "", r"(?:\.\.+|…)", rf"\s*[{LOWER}]"),
        (BREAK, "", rf"[{WIDE}।؟][.!?{WIDE}।؟]*", ""),
        (BREAK, "", rf"(?:^|\s)[{OPEN}]*[^\W\d_]{{2,}}[.!?]+", rf"[{UPPER}][{LOWER}]+(?=[\s,]|$)"),  # the blank was forgotten
        (KEEP, "", "", r"\S"),
        (BREAK, "", "", ""),
    ],
}
FIRST = [(KEEP, "n", "", ""), (KEEP, "fmc", "", rf"\s*[{LOWER}—–,;:\-]")]  # before every language: the outer sentence goes on
WITHIN = [(BREAK, "", "", r"\s+[^\W\d_a-zß-öø-ÿа-яё]"), (KEEP, "", "", "")]


def _compiled(rules: list[tuple]) -> list[tuple]:
    """Before is matched backwards from the place, so its cost does not depend on how long the line is."""
    return [(yes, where, regex.compile(f"(?r)(?:{b})") if b else None, re.compile(a) if a else None) for yes, where, b, a in rules]


TABLES = {x: _compiled(FIRST + RULES[x] + (LATIN if x in COMMON_WORDS else []) + RULES["all"]) for x in RULES if x != "all"}
TABLES["latin"] = _compiled(FIRST + [r for x in COMMON_WORDS for r in RULES[x]] + LATIN + RULES["all"])
_WITHIN = _compiled(WITHIN)
_SCRIPTS = [("th", re.compile("[฀-๿]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ru", re.compile("[Ѐ-ӿ]"))]
_LANGUAGE_OF = {w: [x for x in COMMON_WORDS if w in COMMON_WORDS[x]] for words in COMMON_WORDS.values() for w in words}

SMILEY = r"(?:[:;=]['\-]?[)(DPp\]]|<3|\^\^|[xX]D)"
_PLACE = re.compile(rf"(?P<end>[.!?…。！？।؟︒｡]+)(?P<close>(?:[{CLOSE}]|[   ](?=»)»?)*)(?P<smiley>(?:\s*{SMILEY}(?=\s|$))*)")
_PARTICLE = re.compile(rf"(?:{PARTICLES})(?=\s)")
_ANY = re.compile(r"[.!?…。！？।؟︒｡]")
_SMILEY = re.compile(rf"(?<!\S){SMILEY}(?=\s|$)")
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s*")
_OPENER = re.compile(r"[\"«„“「『(\[]|(?<!\w)'(?=[%s])|(?<!\w)‘" % UPPER)
_PAIRS = {'"': '"', "«": "»", "“": "”", "「": "」", "『": "』", "„": "“”", "(": "()", "[": "[]", "'": "'", "‘": "’"}
_NEXT = {c: re.compile(f"[{re.escape(ends)}]") for c, ends in _PAIRS.items()}
_BEHIND = {"'": re.compile(r"[\s.,!?]|$"), "‘": re.compile(r"\W|$")}


def language_of(line: str) -> str:
    """The table of a line: by its script, and for Latin letters by the commonest words of four languages."""
    for name, some in _SCRIPTS:
        if some.search(line):
            return name
    seen = dict.fromkeys(COMMON_WORDS, 0)
    for w in _LATIN_WORD.findall(line.lower()):
        for x in _LANGUAGE_OF.get(w, ()):
            seen[x] += 1
    best, *rest = sorted(seen.values(), reverse=True)
    return max(seen, key=seen.get) if best > rest[0] else "latin"


def _spans(line: str) -> list[tuple[int, int]]:
    """Quotes and brackets that open and end in the line; outer quotes hide inner ones, of brackets the innermost counts."""
    out, at = [], 0
    last = {c: max(map(line.rfind, ends)) for c, ends in _PAIRS.items() if c in line}
    for m in _OPENER.finditer(line):
        s, c = m.start(), line[m.start()]
        if s < at or last[c] <= s:
            continue
        e = _NEXT[c].search(line, s + 1)
        if e is None or line[e.start()] == c and c in "([" or c in _BEHIND and not _BEHIND[c].match(line, e.end()):
            continue
        out.append((s, e.end()))
        at = e.end()
    return out


def _decided(table: list[tuple], situation: str, line: str, end: int, last: int) -> bool:
    for yes, where, before, after in table:
        if (not where or situation in where) and (before is None or before.match(line, 0, end)) and (after is None or after.match(line, last)):
            return yes
    return BREAK


def line_starts(line: str) -> list[int]:
    """Where the sentences of one line begin; none for a blank line."""
    first = _GAP.match(line).end()
    if first == len(line):
        return []
    starts = [first]
    if not (_ANY.search(line, first, len(line) - 1) or "฀" <= max(line) and _PARTICLE.search(line)):
        return starts
    language = language_of(line)
    table = TABLES[language]
    spans = _spans(_SMILEY.sub(lambda m: "\x00" * len(m.group()), line))
    begins = [s for s, _ in spans]
    places = [(m.start("end"), m.end("end"), m.end("close"), m.end()) for m in _PLACE.finditer(line)]
    if language == "th":
        places = sorted(places + [(m.end(), m.end(), m.end(), m.end()) for m in _PARTICLE.finditer(line)])
    waiting: list[tuple[int, int, int]] = []  # ends within the quotes that opened the sentence: quotes, end, behind it
    for mark, end, close, last in places:
        k = bisect_right(begins, mark) - 1
        inside = k >= 0 and mark < spans[k][1]
        opening = inside and spans[k][0] <= starts[-1]
        if inside and line[end : spans[k][1]].strip("   \"'’”“»)]」』"):
            situation = "n"
            if opening:
                waiting.append((k, end, last))
        elif inside:
            situation, last = "f" if opening else "m", max(last, spans[k][1])
        else:
            situation = "c" if line[end:close].strip() else "s" if last > close else "o"
        after = _GAP.match(line, last).end()
        if after >= len(line) and situation != "n":
            break
        if _decided(table, situation, line, end, last):
            for span, e, behind in waiting if situation == "f" else ():
                begin = _GAP.match(line, behind).end()
                if span == k and begin < after and _decided(_WITHIN, "n", line, e, behind):
                    starts.append(begin)
            starts.append(after)
            waiting = []
    return starts


def sentence_starts(text: str | None) -> list[int]:
    """Positions (code points) of the first visible characters of all sentences; none for null and blank texts."""
    if not text:
        return []
    out, at = [], 0
    for line in text.split("\n"):
        out += [at + s for s in line_starts(line)]
        at += len(line) + 1
    return out


def split_sentences(text: str | None) -> list[str]:
    if not text:
        return []
    starts = sentence_starts(text)
    cut = []
    for s, e in zip(starts, starts[1:] + [len(text)]):
        cut.append(text[s:e].split("\n", 1)[0].rstrip())
    return cut


def sentences(df: DataFrame, texts: str = "comments", with_text: bool = False) -> DataFrame:
    """``(tbl, row_id, comment_ix, start_pos[, sentence])``: one row per sentence of every text of the array.

    Null arrays and elements have none; a line break ends a sentence; repeated rows are split like others.
    """

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                row, ix, start, said = [], [], [], []
                for i, comments in enumerate(part.column(2).to_pylist()):
                    for j, c in enumerate(comments or ()):
                        s = sentence_starts(c)
                        row += [i] * len(s)
                        ix += [j] * len(s)
                        start += s
                        if with_text:
                            said += split_sentences(c)
                at = pa.array(row, pa.int64())
                cols = [part.column(0).take(at), part.column(1).take(at), pa.array(ix, pa.int64()), pa.array(start, pa.int64())]
                names = ["tbl", "row_id", "comment_ix", "start_pos"]
                if with_text:
                    cols.append(pa.array(said, pa.string()))
                    names.append("sentence")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "tbl string, row_id bigint, comment_ix bigint, start_pos bigint" + (", sentence string" if with_text else "")
    return df.select(F.col("tbl"), F.col("row_id").cast("bigint"), F.col(texts).alias("texts")).mapInArrow(run, schema)
