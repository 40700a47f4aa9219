"""Personal information in free text: find mentions, replace them by typed placeholders.

Anchor expansion. One Aho-Corasick pass over the lower-cased text finds anchors: at-signs and their
spelled forms, schemes of addresses on the net, digits, stems of family names, listed given names, words for
streets, labels of identity numbers, number words. At every anchor a local parser for its kind expands left
and right, as far as its form goes, and validates the boundary; account numbers are checked by their check
digits. What lies within a net address is no mention. Overlapping finds are settled in the order of the parsers.
Names are recognised by morphology - stems and endings of family names are derived from the name list, so that
names missing from the (incomplete) list are found too - and by a listed given name before an unlisted
capitalised word that the text does not use as an ordinary one.

The automaton and the name list are small and fixed; they are shipped in the closure.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "address", "id_number", "phone", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
NAMES_AT_MOST = 100_000  # rows of the name list that may be brought to the driver; more are refused

# Spelled at-signs and dots, number words, labels of identity numbers, words of streets.
AT = ["@", "＠", "[at]", "(at)", "_at_", " at ", "{at}"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
ID_LABELS = ["passport", "social", "ssn", "national id", "id card", "nin ", "tax number", "tax id", "id =", "id:", "licence", "license", "dni", "паспорт", "ausweis", "护照", "身份证", "パスポート", "insurance number"]
STREET_AFTER = ["street", "st", "lane", "close", "avenue", "rd.", "rd", "road", "drive", "way", "court", "place"]
STREET_BEFORE = ["calle ", "rue de ", "ul. ", "via ", "rua "]
STREET_JOINED = ["straße", "strasse", "weg", "gasse", "laan", "straat"]
NOT_STREET = {"pack", "kit", "set", "files", "edition", "album"}
# Words before a family name that are no given names.
NOT_GIVEN = set(
    "the a an to is are was and or of at in on by for from with reads lists reach met meet regards buyer seller vendor user name named hi hello dear thanks "
    "herr frau mr mrs ms dr sr sra senor m mme de del la le les à a an ist bei bitte llamo appelle m'appelle j'appelle имя на от y e et und oder que says said "
    "ask call see contact login as under lives wants want his her their our my your this that street phone mail write ship send sent paid pay invoice passport id".split()
)

SCHEME = "://"

LATIN = "A-Za-zÀ-ÖØ-öø-ž"
# (?r): matched backwards from the anchor, however long the word is
_WORD_BEFORE = regex.compile(rf"(?r)([{LATIN}]+(?:['’][{LATIN}]+)?(?:-[{LATIN}]+)?)( [A-Za-z]\.)? ")
_FULL_NAME = re.compile(rf"(?: [A-Z]\.)? ([A-ZÀ-ÖØ-Þ][a-zß-öø-ž]{{2,}}(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ž]+)?)(?![{LATIN}\d_'’@./-])")
_SMALL = re.compile(rf"(?<![{LATIN}])[a-zß-öø-ž]+(?![{LATIN}])")
_URL_END = re.compile(r"[\s<>\"'()\[\]{}]|$")
_FAMILY_TAIL = re.compile(rf"(?:-[{LATIN}]+)?")
_GIVEN_AFTER = re.compile(rf", ?([{LATIN}]+(?:-[{LATIN}]+)?)(?: [A-Za-z]\.)?")
_LOCAL = regex.compile(r"(?r)[A-Za-z0-9._%+\-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:(?:\.|(?: ?\[dot\] ?)|(?: ?\(dot\) ?)|_dot_| dot )[A-Za-z0-9\-]+)*(?:\.|(?: ?\[dot\] ?)|(?: ?\(dot\) ?)|_dot_| dot )(?:[A-Za-z]{2,})(?![A-Za-z0-9])", re.I)
_SPELLED_DOT = re.compile(r"\[dot\]|\(dot\)|_dot_| dot ", re.I)
_NUMBER_WORDS = re.compile("(?:%s)(?:[ \\-](?:%s)){6,14}(?![A-Za-z])" % ("|".join(NUMBER_WORDS), "|".join(NUMBER_WORDS)), re.I)
_BEFORE_DIGIT = regex.compile(r"(?r)(?:[+＋(]{1,2}|[A-Za-z]{1,2} ?)")
_DIGITS = re.compile(r"(?<![A-Za-z\d_.])(?:[+＋(]{0,2}\d|[A-Za-z]{1,2} ?\d)")
_PHONES = [
    re.compile(p)
    for p in (
        r"[+＋]\d{1,3}[ .\-]?\(\d{2,4}\) ?\d{3,4}[ .\-]?\d{3,4}(?: ext\. ?\d+)?",
        r"\(\d{2,4}\) ?\d{3,4}[ .\-]\d{3,4}(?: ext\. ?\d+)?",
        r"[+＋]\d{10,14}",
        r"[+＋]\d{1,3}(?:[ .\-]\d{2,7}){2,4}",
        r"00\d{2,3}(?:[ .\-]\d{2,7}){2,4}",
        r"\d{3}([ .\-])\d{3}\1\d{4}(?: ext\. ?\d+)?",
        r"0\d{2,4} \d{3,4} \d{3,4}",
        r"\d(?: \d){9,12}",
        r"\d{10}",
    )
]
_IDS = [
    re.compile(p)
    for p in (
        r"[A-Za-z]\d{7}",
        r"[A-Za-z]{2}\d{6}[A-Da-d]",
        r"[A-Za-z]{2} \d\d \d\d \d\d [A-Da-d]",
        r"[A-Za-z]\d{3}-\d{4}-\d{4}",
        r"\d{6}/\d{3,4}",
        r"\d{8}-[A-Za-z]",
        r"\d{3}([ \-])\d{2}\1\d{4}",
        r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    )
]


def _luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + doubled) % 10 == 0


def _mod97(number: str) -> bool:
    plain = "".join(number.split()).upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


# account numbers, by form and check digits: cards and international bank accounts
_ACCOUNTS = [(re.compile(r"\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}"), _luhn), (re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?"), _mod97)]
_NO_MENTION = regex.compile(r"(?r)(?:serial|ticket|hash|order|batch|invoice no|ver\.?|version|build|tracking)(?: no\.?| number| nr\.?)?[ :#]*", regex.I)
_END = re.compile(r"(?![A-Za-z\d_]|[.\-/][A-Za-z\d])")
_AFTER_LABEL = re.compile(r"(?: ?no\.?| ?nr\.?| ?number| ?nummer| is)?[ :=：]{1,3}(?=((?:[A-Za-z]{1,2} ?)?\d(?:[\d./\- ]?\d){5,14}(?:-?[A-Za-z](?![A-Za-z]))?))", re.I)
_INITIAL_BEFORE = re.compile(r"(?<![A-Za-z.])[A-Za-z]\. $")
_MASK = re.compile(r"[A-Z]+__TOKEN")
_STREET_LEFT = regex.compile(r"(?r)(?:(?:flat|apt\.?|unit) \d+[a-z]?, ?)?(?:no\. ?)?\d+[a-z]? (?:[^\W\d_]+[ '\-])?[^\W\d_]+ ", regex.I)
_NUMBER_LEFT = regex.compile(r"(?r)(?:(?:flat|apt\.?|unit) \d+[a-z]?, ?)?(?:no\. ?)?\d+[a-z]?,? ", regex.I)
_BEFORE_RIGHT = re.compile(r"[^\W\d_]+(?:[ \-][^\W\d_]+)?,? \d+[a-z]?(?:/\d+)?", re.I)
_WORD_RIGHT = re.compile(r"[^\W\d_]+")
_JOINED_RIGHT = re.compile(r" \d+[a-z]?(?![\w])", re.I)
_JOINED_LEFT = regex.compile(r"(?r)[^\W\d_]+")
_UNIT = re.compile(r", (?:apt|flat|unit)\.? \d+[a-z]?", re.I)
_TOWN = re.compile(r", (?:(?:port|san|saint|st\.|bad|new) )?[^\W\d_]+(?: \d{4,6})?(?![\w])", re.I)


def family_morphology(families: list[str]) -> tuple[set[str], set[str]]:
    """Stems and endings that recur in the listed family names, each in lower case.

    Every name is split where the less frequent of its two parts is most frequent in the list.
    """
    lower = sorted({f.lower() for f in families if f and len(f) >= 6})
    stems, ends = Counter(), Counter()
    for f in lower:
        for k in range(3, len(f) - 2):
            stems[f[:k]] += 1
            ends[f[k:]] += 1
    chosen = Counter()
    kept: list[tuple[str, str]] = []
    for f in lower:
        k = max(range(3, len(f) - 2), key=lambda k: (min(stems[f[:k]], ends[f[k:]]), -k), default=None)
        if k and min(stems[f[:k]], ends[f[k:]]) >= 2:
            kept.append((f[:k], f[k:]))
            chosen[f[k:]] += 1
    return {s for s, _ in kept}, {e for _, e in kept}


def same_length_lower(text: str) -> str:
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    def __init__(self, given: list[str], families: list[str]) -> None:
        self.given = {g.lower() for g in given if g}
        self.stems, self.ends = family_morphology(families)
        self.listed = {f.lower() for f in families if f}
        self.auto = None

    def __getstate__(self):
        return self.__dict__ | {"auto": None}

    def _automaton(self):
        keys: dict[str, str] = {}
        for words, role in ((AT, "at"), (NUMBER_WORDS, "words"), (STREET_BEFORE, "before"), (STREET_JOINED, "joined"), (ID_LABELS, "label")):
            keys |= dict.fromkeys(words, role)
        keys |= {f" {w}": "after" for w in STREET_AFTER}
        keys |= {chr(c): "digit" for c in range(0x10000) if chr(c).isdecimal()} | {SCHEME: "scheme"}
        keys |= dict.fromkeys(self.given, "given")
        keys |= dict.fromkeys(self.stems | self.listed, "family")
        auto = ahocorasick.Automaton()
        for key, role in keys.items():
            auto.add_word(key, (role, len(key)))
        auto.make_automaton()
        stem_end = "|".join(sorted(map(re.escape, self.ends), key=len, reverse=True)) or "(?!)"
        stem = "|".join(sorted(map(re.escape, self.stems), key=len, reverse=True)) or "(?!)"
        listed = "|".join(sorted(map(re.escape, self.listed), key=len, reverse=True)) or "(?!)"
        self.family = re.compile(rf"(?:(?:{stem})(?:{stem_end})|{listed})(?![{LATIN}])")
        self.double = re.compile(rf"-(?={self.family.pattern})")
        self.auto = auto

    # each parser returns (start, end) or None; low has the length of text
    def _email(self, text: str, low: str, at: int, size: int):
        left, right = at, at + size
        if low[at : at + size] == " at ":
            pass
        else:
            if left and text[left - 1] == " ":
                left -= 1
            if right < len(text) and text[right] == " ":
                right += 1
        local = _LOCAL.match(text, 0, left)
        if not local:
            return None
        start = local.start()
        while start < left and text[start] in "._%+-":
            start += 1
        domain = _DOMAIN.match(text, right)
        if start == left or not domain:
            return None
        spelled = _SPELLED_DOT.search(domain.group())
        if low[at : at + size] == " at " and not spelled:
            return None
        end = domain.end()
        if spelled and spelled.group().lower() == " dot ":  # "x at y dot z and": the domain goes on while "dot" follows
            more = re.compile(r"(?: dot [A-Za-z0-9\-]+)+", re.I).match(text, end)
            end = more.end() if more else end
        return start, end

    def _address(self, text: str, low: str, at: int, size: int, role: str, cased: bool):
        if role == "after":
            end = at + size
            if end < len(text) and (low[end].isalnum() or low[end] == "_"):
                return None
            m = _STREET_LEFT.match(low, 0, at + 1)
            if not m:
                return None
            nxt = _WORD_RIGHT.match(low, end + 1) if low[end : end + 1] == " " else None
            if nxt and nxt.group() in NOT_STREET:
                return None
            start = m.start()
            if low[end : end + 1] == "." and low[at + 1 : end] in ("st", "rd"):
                end += 1
        elif role == "before":
            if at and low[at - 1].isalnum():
                return None
            tail = low[at : at + size]
            number = _NUMBER_LEFT.match(low, 0, at)
            if number:
                w = _WORD_RIGHT.match(low, at + size)
                if not w:
                    return None
                start, end = number.start(), w.end()
            else:
                w = _BEFORE_RIGHT.match(low, at + size)
                if not w or tail == "rue de ":
                    return None
                start, end = at, w.end()
        else:
            w, n = _JOINED_LEFT.match(low, 0, at), _JOINED_RIGHT.match(low, at + size)
            if not w or not n or len(w.group()) < 3:
                return None
            start, end = w.start(), n.end()
        if start and low[start - 1].isalnum():
            return None
        for follow in (_UNIT, _TOWN):
            m = follow.match(text, end)
            # a town is capitalised where the text has capitals at all
            if m and (follow is _UNIT or not cased or m.group()[2:3].isupper()):
                end = m.end()
        return start, end

    def _name(self, text: str, low: str, at: int, cased: bool):
        if at and (low[at - 1].isalnum() and low[at - 1].isascii() or low[at - 1] in "@._/"):
            return None
        m = self.family.match(low, at)
        if not m:
            return None
        if cased and not text[at].isupper():
            return None
        if at and low[at - 1] == "-":  # second half of a double name
            return None
        end = m.end()
        tail = self.double.match(low, end)
        if tail:
            end = self.family.match(low, tail.end()).end()
        before = _WORD_BEFORE.match(text, 0, at)
        after = _GIVEN_AFTER.match(text, end)
        if before:
            word = before.group(1)
            plain = word.lower()
            known = plain in self.given or any(p in self.given for p in plain.split("-"))
            reverse = after and after.group(1).lower() in self.given and not known
            if not reverse and plain not in NOT_GIVEN and (not cased or word[0].isupper()) and len(plain) > 1:
                return before.start(1), end
        if initial := _INITIAL_BEFORE.search(text, max(0, at - 4), at):
            return initial.start(), end
        if after and (not cased or after.group(1)[0].isupper()) and after.group(1).lower() not in NOT_GIVEN:
            return at, after.end()
        return None

    def _given(self, text: str, low: str, at: int, size: int, ordinary: set[str]):
        """A listed given name before one capitalised word: only where case tells names, and not if the word also stands in small letters."""
        end = at + size
        if not text[at].isupper() or at and (low[at - 1].isalnum() or low[at - 1] in "@._/-"):
            return None
        m = _FULL_NAME.match(text, end)
        if not m or m.group(1).lower() in ordinary or m.group(1).lower() in NOT_GIVEN:
            return None
        return at, m.end()

    def _number(self, text: str, at: int):
        if _NO_MENTION.match(text, 0, at):
            return None
        for form, valid in _ACCOUNTS:
            m = form.match(text, at)
            if m and _END.match(text, m.end()) and valid(m.group()):
                return "id_number", m.start(), m.end()
        for kind, forms in (("id_number", _IDS), ("phone", _PHONES)):
            for form in forms:
                m = form.match(text, at)
                if m and _END.match(text, m.end()):
                    return kind, m.start(), m.end()
        return None

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in the order of their starts; nothing for null and empty texts."""
        if not text:
            return []
        if self.auto is None:
            self._automaton()
        low = same_length_lower(text)
        cased = low != text and _MASK.sub("", text) != _MASK.sub("", text).lower()
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        given: list[tuple[int, int]] = []
        last_words = numbers_done = url_end = -1
        for last, (role, size) in self.auto.iter(low):
            at = last - size + 1
            r, kind = None, ""
            if role == "digit":
                if at < numbers_done or at and text[at - 1].isdigit() or at < url_end:
                    continue
                before = _BEFORE_DIGIT.match(text, 0, at)
                for start in range(before.start() if before else at, at + 1):
                    if _DIGITS.match(text, start) and (number := self._number(text, start)):
                        found[number[0]].append(number[1:])
                        numbers_done = number[2]
                        break
                continue
            if role == "scheme":
                url_end = _URL_END.search(text, last + 1).start() if last >= url_end else url_end
            elif role == "at":
                r, kind = self._email(text, low, at, size) if at >= url_end else None, "email"
            elif role == "family":
                r, kind = self._name(text, low, at, cased), "name"
            elif role == "given":
                if cased:
                    given.append((at, size))
            elif role == "words":
                kind = "phone"
                if at > last_words and not (at and low[at - 1].isalpha()):
                    m = _NUMBER_WORDS.match(low, at)
                    if m:
                        r, last_words = (m.start(), m.end()), m.end()
            elif role == "label":
                kind = "id_number"
                m = _AFTER_LABEL.match(text, last + 1)
                if m and not any(p.match(text, m.end()) for p in _PHONES):
                    r = m.span(1)
            else:
                r, kind = self._address(text, low, at, size, role, cased), "address"
            if r:
                found[kind].append(r)
        if given:
            ordinary = set(_SMALL.findall(text))
            found["name"] += [r for at, size in given if (r := self._given(text, low, at, size, ordinary))]
        taken: list[tuple[int, int, str]] = []  # in order, none overlapping
        for kind in KINDS:
            for s, e in sorted(set(found[kind]), key=lambda x: (x[0], -x[1])):
                k = bisect_left(taken, (e,))
                if k == 0 or taken[k - 1][1] <= s:
                    taken.insert(k, (s, e, kind))
        return [(k, s, e) for s, e, k in taken]

    def mask(self, text: str | None) -> str | None:
        """The text with each mention replaced; null stays null, a text without mentions stays as it is."""
        if not text:
            return text
        out, at = [], 0
        for kind, s, e in self.find(text):
            out += [text[at:s], PLACEHOLDER[kind]]
            at = e
        return "".join(out) + text[at:] if out else text


def finder(names: DataFrame) -> Finder:
    """From the name list ``(name, kind)``; refuses a list beyond its documented bound."""
    rows = names.where("name is not null").limit(NAMES_AT_MOST + 1).collect()
    if len(rows) > NAMES_AT_MOST:
        raise ValueError(f"the name list has more than {NAMES_AT_MOST} rows")
    return Finder([r["name"] for r in rows if r["kind"] == "given"], [r["name"] for r in rows if r["kind"] == "family"])


def mentions(df: DataFrame, find: Finder, texts: str) -> DataFrame:
    """``(tbl, row_id, comment_ix, kind, start_pos, end_pos)`` of all mentions in the array ``texts``.

    Positions count code points from 0. Null arrays and elements have no mentions, repeated rows are
    searched like others.
    """

    def run(batches):
        for b in batches:
            tbl, rid = b.column(0), b.column(1)
            row, ix, kind, start, end = [], [], [], [], []
            for i, comments in enumerate(b.column(2).to_pylist()):
                for j, c in enumerate(comments or ()):
                    for k, s, e in find.find(c):
                        row.append(i), ix.append(j), kind.append(k), start.append(s), end.append(e)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [tbl.take(at), rid.take(at), pa.array(ix, pa.int64()), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["tbl", "row_id", "comment_ix", "kind", "start_pos", "end_pos"],
            )

    return df.select(F.col("tbl"), F.col("row_id").cast("bigint"), F.col(texts).alias("texts")).mapInArrow(run, "tbl string, row_id bigint, comment_ix bigint, kind string, start_pos bigint, end_pos bigint")


def masked(df: DataFrame, find: Finder, texts: str) -> DataFrame:
    """``(tbl, row_id, texts)``: every row once, its array with each mention replaced by a placeholder."""

    def run(batches):
        for b in batches:
            out = [None if cs is None else [find.mask(c) for c in cs] for cs in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["tbl", "row_id", "texts"])

    return df.select(F.col("tbl"), F.col("row_id").cast("bigint"), F.col(texts).alias("texts")).mapInArrow(run, "tbl string, row_id bigint, texts array<string>")
