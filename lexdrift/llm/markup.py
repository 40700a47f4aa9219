"""Markup residue: structure and clean text of comments in HTML, Markdown, wiki or LaTeX markup.

A comment is read into a tree of nodes: elements of HTML, and blocks and lines of the other languages as
nodes of the same tree (fence, indented block, environment, marked line). Each node is described by
features of itself, its subtree, its siblings and the whole comment, and boosted trees choose its kind.
The decoder goes from the root down: what is chosen code or formula takes its whole subtree, so that
no descendant contradicts an ancestor, and a heading or list item takes its line.

The trees are fitted on a bounded sample of comments without labels, by co-training on two views of a node:

* What the flattened text beside the markup shows: a region that is dropped there is code or a formula, a mark
  that is dropped stood for structure, what stays as it is is neither. This leaves a set of kinds for every node.
* A line whose letters also stand as an ordinary line elsewhere in the sample is an ordinary line.
* The names that the elements of HTML bear (h1 to h6, li, pre, math, p) choose the kind within the set. Trees on the
  *content view* (text, subtree, siblings, depth; no tag, mark or attribute) carry it over to nodes of all other
  forms, node by node and on average over each form: a short line alone among paragraphs is a heading and a
  run of short lines a list, whatever mark they bear.
* Trees on all features, with tags, marks and hashed attribute tokens, are then fitted on these kinds.

No rule says what a mark of Markdown, wiki or LaTeX means.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.boosting import BoostedTrees
from lexdrift.llm.common import first_by_hash

KINDS = ["other", "heading", "list_item", "code", "formula"]
OTHER, HEADING, ITEM, CODE, FORMULA = range(5)
SAMPLE_ROWS = 2000  # rows from which the model is fitted, at most, the first by a hash
FORM_ROWS, FORM_WEIGHT, RARE_TIMES = 1200, 2000, 20  # nodes of one form used in the fit, what they count together, and one of them at most

FORM_POWER, LEAST = 12, 0.05  # the weight of a form's average against the node itself, and the least that a node says of any kind
DROPPED_MARK = 0.05  # how often, before the content is looked at, a mark that the flattened text drops stands for no structure

# Regions whose content is not read further. The leftmost wins, so markup inside code stays code.
_REGION = re.compile(
    r"""(?=[<`~\\$])(?:
    (?P<block><(?P<tag>pre|source|syntaxhighlight|listing|xmp|math|code)\b(?P<attr>[^>]*)>.*?(?:</(?P=tag)\s*>|\Z))
  | (?P<fence>(?<![^\n])(?P<bar>```+|~~~+)[^\n]*\n(?:.*?\n)??[ ]{0,3}(?P=bar)[`~]*[ \t]*$)
  | (?P<env>\\begin\{(?P<name>verbatim\*?|lstlisting|minted|Verbatim|equation\*?|align\*?|displaymath|math|gather\*?|eqnarray\*?)\}.*?\\end\{(?P=name)\})
  | (?P<span><span\b(?P<cls>[^>]*\bclass=["']?(?:tex|math|katex|latex)\b[^>]*)>.*?</span\s*>)
  | (?P<display>(?<!\\)\$\$.+?(?<!\\)\$\$|\\\[.+?\\\])
  | (?P<inline>\\\(.+?\\\)|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?[^\s\\$]\$(?![\w$]))
    )""",
    re.X | re.S | re.M | re.I,
)
_INDENT = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z)(?:[ \t]*\n(?= {4}|\t))*)+")
_OPENING = re.compile(r"<(?:pre|source|syn|listing|xmp|math|code|span)|```|~~~|\\begin|\\\[|\\\(|\$", re.I)
_NOT_ALNUM, _DIGIT = re.compile(r"[\w ]+"), re.compile(r"\d")
_TAG = re.compile(r"<(/?)(h[1-6]|li|dt|dd|p|div|blockquote|ul|ol|td|tr|table|section|article)\b([^<>]*)>", re.I)
_BREAK = re.compile(r"<br\s*/?>", re.I)
_LINE = re.compile(
    r"[ \t]*(?P<mark>\#{1,6}(?=\s)|[*#:;]{1,5}(?=\s)|[-+•](?=\s)|\d{1,3}[.)](?=\s)|={2,6}(?=[^=\n]*[^=\s][^=\n]*={2,6}\s*(?:\{\{|<|$))|>|\\item\b|\\(?:sub)*section\*?(?=\{)|\\(?:sub)?paragraph\*?(?=\{)|\\chapter\*?(?=\{))?"
)
_UNDER = re.compile(r"[ \t]*(=+|-+)[ \t]*$")
MARKS = {"#": 1, "##": 2, "*": 3, "**": 4, "-": 5, "+": 6, "1": 7, "==": 8, ">": 9, "item": 10, "section": 11, ":": 12, ";": 13, "•": 14}
_MATH = re.compile(r"\\[a-zA-Z]+|[\^_]|(?<=\w) ?= ?(?=\S)|\\leq")
_CODEY = re.compile(r"[;(){}<>=$|&]|->|::|//|\bdef\b|\becho\b|\bSELECT\b|\bimport\b|#include|:\s*\d+$", re.M)
# What tells the markup languages apart, counted over a whole comment.
_SIGNS = {
    "html": ["</", "<br", "<p>", "<li", "<P>"],
    "md": ["**", "~~", "](", "`", " _", "_ "],
    "wiki": ["[[", "{{", "''", "[http", "<ref>"],
    "latex": ["\\textbf", "\\emph", "\\texttt", "\\href", "{\\em", "\\begin", "\\item", "\\section", "\\\\\n", "\\_", "\\$", "\\paragraph", "\\subsection"],
}


def _signs(raw: str) -> list[int]:
    return [sum(map(raw.count, literals)) for literals in _SIGNS.values()]



ATTR_BUCKETS = 16  # columns that the tokens of attributes are hashed to
CONTENT = (
    "depth children siblings same_before same_after position chars words symbols math codey density digits stop_end blank_before blank_after lines upper colon_pairs run currency "
    "sub_chars sub_nodes sub_depth sub_density mean_sibling".split()
)
# the content view: of lines, which may be structure, and of regions, which may be code or formulas
LINE_VIEW, REGION_VIEW = "same_before same_after chars words stop_end lines upper colon_pairs".split(), "chars words symbols math codey digits stop_end lines upper".split()
FORM = "region under closed html md wiki latex has_item_near own_start own_end".split() + [f"attr{i}" for i in range(ATTR_BUCKETS)]
FEATURES = ["tag", "mark", *CONTENT, *FORM]
_FLOW = {"line", "p", "div", "blockquote", "ul", "td"}
TAGS = {t: i for i, t in enumerate("line h li pre source syntaxhighlight math fence env_code env_math span display inline indent code p div blockquote ul td listing".split())}
_ATTR_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "mark", "attr", "text", "start", "end", "depth", "children", "parent", "closed", "under", "blank", "run", "under_text", "sub")

    def __init__(self, tag, text, start, end, depth=0, mark="", attr="", parent=-1, closed=True):
        self.tag, self.text, self.start, self.end, self.depth, self.mark, self.attr, self.parent, self.closed = tag, text, start, end, depth, mark, attr, parent, closed
        self.children, self.under, self.blank, self.run, self.under_text, self.sub = 0, 0, [0, 0], 0, "", (0, 0, 0)


def _mark_name(mark: str) -> str:
    if not mark:
        return ""
    if mark[0].isdigit():
        return "1"
    if mark.startswith("\\item"):
        return "item"
    if mark[0] == "\\":
        return "section"
    if mark[0] == "=":
        return "=="
    if mark[0] == "#":
        return "#" if len(mark) == 1 else "##"
    if mark[0] == "*":
        return "*" if len(mark) == 1 else "**"
    return mark[0]


def parse(raw: str) -> list[Node]:
    """Nodes of a comment in the order of their starts."""
    nodes: list[Node] = []
    stack: list[tuple[str, int]] = []
    at = 0
    regions = _regions(raw)
    if "\n\n    " in raw or "\n\n\t" in raw or raw[:4] == "    " or raw[:1] == "\t":
        regions = sorted([*regions, *_INDENT.finditer(raw)], key=lambda m: m.start())
    for m in [*regions, None]:
        if m and m.start() < at:  # inside the region before
            continue
        end = m.start() if m else len(raw)
        _flow(raw, at, end, nodes, stack)
        if m is None:
            break
        if m.re is _INDENT:
            tag, attr = "indent", ""
        elif m.group("block"):
            tag, attr = m.group("tag").lower(), m.group("attr")
        elif m.group("env"):
            tag, attr = ("env_code" if m.group("name").rstrip("*") in ("verbatim", "lstlisting", "minted", "Verbatim") else "env_math"), m.group("name")
        elif m.group("span"):
            tag, attr = "span", m.group("cls")
        elif m.group("fence"):
            tag, attr = "fence", ""
        else:
            tag, attr = ("display" if m.group("display") else "inline"), ""
        parent = stack[-1][1] if stack else -1
        if parent >= 0:
            nodes[parent].children += 1
        nodes.append(Node(tag, m.group(), m.start(), m.end(), len(stack) + 1, "", attr, parent))
        at = m.end()
    for _, n in stack:  # never closed
        nodes[n].end, nodes[n].closed = len(raw), False
    _neighbours(raw, nodes)
    return nodes


def _regions(raw: str) -> list[re.Match]:
    """Regions from left to right. An opening whose closing is nowhere behind it is not tried again, so the time is linear."""
    out, at, never = [], 0, set()
    for o in _OPENING.finditer(raw):
        if o.start() < at:
            continue
        close = _closing(raw, o)
        if close is not None:
            if close.pattern in never:
                continue
            if not close.search(raw, o.end()):
                never.add(close.pattern)
                continue
        if m := _REGION.match(raw, o.start()):
            out.append(m)
            at = max(m.end(), o.start() + 1)
    return out


@lru_cache(maxsize=1000)
def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.M | re.I)


def _closing(raw: str, o: re.Match) -> re.Pattern | None:
    """What must follow an opening for it to be a region; None where the search for it is bounded anyway."""
    t = o.group().lower()
    if t == "\\begin":
        name = re.compile(r"\{(\w+\*?)\}").match(raw, o.end())
        return _pattern(r"\\end\{" + re.escape(name.group(1)) + r"\}") if name else None
    if t[0] in "`~":
        bar = re.compile(r"[`~]+").match(raw, o.start()).group()
        return _pattern(rf"^ {{0,3}}{re.escape(bar)}[`~]*[ \t]*$")
    if t == "$" and raw[o.end() : o.end() + 1] == "$":
        return _pattern(r"\$\$")
    return {"\\[": _pattern(r"\\\]"), "\\(": _pattern(r"\\\)"), "<span": _pattern("</span")}.get(t)


def _flow(raw: str, start: int, end: int, nodes: list[Node], stack: list[tuple[str, int]]) -> None:
    """Elements and lines of the text between two regions."""
    at = start
    for m in _TAG.finditer(raw, start, end):
        _lines(raw, at, m.start(), nodes, stack)
        at = m.end()
        tag = m.group(2).lower()
        tag = "h" if tag[0] == "h" and len(tag) == 2 else tag
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for _, n in stack[k:]:
                        nodes[n].end = m.start()
                    del stack[k:]
                    break
        else:
            if tag in ("li", "p", "dt", "dd") and stack and stack[-1][0] == tag:  # an unclosed one before
                nodes[stack[-1][1]].end = m.start()
                nodes[stack[-1][1]].closed = False
                stack.pop()
            parent = stack[-1][1] if stack else -1
            if parent >= 0:
                nodes[parent].children += 1
            nodes.append(Node(tag if tag in TAGS else "div", "", m.end(), m.end(), len(stack) + 1, "", m.group(3), parent))
            stack.append((tag, len(nodes) - 1))
    _lines(raw, at, end, nodes, stack)


def _lines(raw: str, start: int, end: int, nodes: list[Node], stack: list[tuple[str, int]]) -> None:
    at = start
    while at < end:
        stop = raw.find("\n", at, end)
        stop = end if stop < 0 else stop
        begins = at == 0 or raw[at - 1] == "\n"
        m = _LINE.match(raw, at, stop) if begins else None
        text = raw[m.end() if m else at : stop].strip()
        if text or m and m.group("mark"):
            if begins and nodes and (u := _UNDER.match(raw, at, stop)) and nodes[-1].tag == "line" and nodes[-1].end == at - 1 and not nodes[-1].mark:
                nodes[-1].under = 1 if u.group(1)[0] == "=" else 2
                nodes[-1].under_text = u.group(1)
                nodes[-1].end = stop
            else:
                parent = stack[-1][1] if stack else -1
                if parent >= 0:
                    nodes[parent].children += 1
                    if not nodes[parent].text:
                        nodes[parent].text = text
                nodes.append(Node("line", text, at, stop, len(stack) + 1, _mark_name(m.group("mark") or "") if m else "", "" if begins else "inner", parent))
        at = stop + 1


def _neighbours(raw: str, nodes: list[Node]) -> None:
    for n in nodes:
        n.blank[0] = int(n.start == 0 or raw[max(0, n.start - 2) : n.start] == "\n\n")
        n.blank[1] = int(n.end >= len(raw) or raw[n.end : n.end + 2] == "\n\n")
    joined = [bool(i and n.mark and nodes[i - 1].mark and n.mark.strip("#*") == nodes[i - 1].mark.strip("#*") and n.mark[0] == nodes[i - 1].mark[0] and n.start - nodes[i - 1].end <= 1) for i, n in enumerate(nodes)]
    for i, n in enumerate(nodes):
        n.run = nodes[i - 1].run + 1 if joined[i] else 1
    for i in range(len(nodes) - 2, -1, -1):
        if joined[i + 1]:
            nodes[i].run = nodes[i + 1].run  # length of the whole run
    for i in range(len(nodes) - 1, -1, -1):  # characters, nodes and levels below each node; parents come first
        n = nodes[i]
        chars, below, deep = n.sub
        if not n.children:
            chars += len(n.text)
        n.sub = (chars, below, deep)
        if n.parent >= 0:
            c, b, d = nodes[n.parent].sub
            nodes[n.parent].sub = (c + chars, b + below + 1, max(d, deep + 1))


def _same(a: Node, b: Node) -> bool:
    return (a.tag, a.mark, a.under) == (b.tag, b.mark, b.under)


def features(raw: str, nodes: list[Node]) -> list[list[float]]:
    signs = _signs(raw)
    items = sum(n.tag == "li" or n.mark == "item" for n in nodes)
    siblings: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        siblings.setdefault(n.parent, []).append(i)
    rows = []
    place = {i: k for ids in siblings.values() for k, i in enumerate(ids)}
    mean = {p: sum(nodes[i].sub[0] for i in ids) / len(ids) for p, ids in siblings.items()}
    for i, n in enumerate(nodes):
        t, own = n.text.strip("{}#= ") if n.mark else n.text, siblings[n.parent]
        k = place[i]
        size = max(1, len(t))
        whole = max(1, n.end - n.start)
        words = t.count(" ") + 1
        read = n.mark or n.tag not in _FLOW  # signs of code and formulas count where they can decide
        attr = [0.0] * ATTR_BUCKETS
        if n.attr and n.tag != "line":
            for token in _ATTR_TOKEN.findall(n.attr.lower()):
                attr[zlib.crc32(token.encode()) % ATTR_BUCKETS] = 1.0
        rows.append([
            TAGS[n.tag], MARKS.get(n.mark, 0), n.depth, n.children, len(own),
            float(k > 0 and _same(nodes[own[k - 1]], n)),
            float(k + 1 < len(own) and _same(nodes[own[k + 1]], n)),
            k / len(own), len(t), words, len(_NOT_ALNUM.sub("", t)) / size if read else 0.0,
            len(_MATH.findall(t)) if read else 0, len(_CODEY.findall(t)) if read else 0, len(t) / whole, len(_DIGIT.findall(t)) / size if read else 0.0,
            float(t[-1:] in ".!?。！？।؟…"), n.blank[0], n.blank[1], t.count("\n") + 1, float(t[:1].isupper()), t.count(": "), min(n.run, 9), float(t[:1] == "$" and t[1:2].isdigit()),
            n.sub[0], n.sub[1], n.sub[2], n.sub[0] / whole, mean[n.parent],
            float(n.tag not in _FLOW and n.tag not in ("h", "li")), n.under, float(n.closed), *(min(s, 9) for s in signs), min(items, 9),
            float(n.start == 0 or raw[n.start - 1] in "\n>"), float(n.end == len(raw) or raw[n.end] in "\n<"), *attr,
        ])
    return rows


def design(rows: list[list[float]]) -> np.ndarray:
    """Feature matrix with the two categorical features, tag and mark, spread over columns of their own after the others."""
    x = np.array(rows, float).reshape(-1, len(FEATURES))
    tags, marks = np.eye(len(TAGS))[x[:, 0].astype(int)], np.eye(len(MARKS) + 1)[x[:, 1].astype(int)]
    return np.concatenate([x[:, 2:], tags, marks], axis=1)


# Kinds that bear their name in HTML.
NAMED = {"h": HEADING, "li": ITEM, "pre": CODE, "math": FORMULA, "p": OTHER, "div": OTHER, "blockquote": OTHER, "ul": OTHER, "td": OTHER}


class Flat:
    """The flattened text beside a comment, prepared for questions about what was dropped."""

    def __init__(self, text: str) -> None:
        self.all, self.lines = _squeeze(text), {_squeeze(x) for x in text.split("\n")}

    def allowed(self, n: Node, raw: str) -> tuple[int, ...]:
        """The kinds that the flattened text leaves for a node; empty where it says nothing."""
        if n.tag in ("line", *_FLOW, "h", "li"):
            if n.tag != "line":
                return ()
            bare = _squeeze(_plain(n.text.strip("{}#= ") if n.mark else n.text, True))
            if n.under:
                return (HEADING, ITEM, OTHER) if bare in self.lines and n.under_text not in self.lines else ()
            if n.mark and bare in self.lines:
                return HEADING, ITEM, OTHER
            return (OTHER,) if bare in self.lines or _squeeze(raw[n.start : n.end]) in self.all else ()
        body = _squeeze(html.unescape(_MATH_SHELL.sub("", _CODE_SHELL.sub("", n.text))))
        kept = _squeeze(n.text) in self.all or n.tag not in ("inline", "display") and body in self.all
        return (OTHER,) if kept else (CODE, FORMULA)


def _squeeze(t: str) -> str:
    return "".join(t.split())


def _form(n: Node) -> tuple:
    return n.tag, n.mark, n.under, min(n.run, 2)


def _letters(t: str) -> str:
    return "".join(filter(str.isalpha, t)).lower()


def _co_trained(x: np.ndarray, sets: list[tuple], weight: np.ndarray, forms: dict[tuple, list[int]], ordinary: np.ndarray) -> np.ndarray:
    """A kind for every node out of its set: sure ones as they are, others by trees on the content view and the average of their form."""
    y = np.array([s[0] for s in sets])
    size = np.array([len(s) for s in sets])
    for kinds, names in (((HEADING, ITEM, OTHER), LINE_VIEW), ((CODE, FORMULA), REGION_VIEW)):
        view = [CONTENT.index(c) for c in names]
        sure, left = np.flatnonzero((size == 1) & np.isin(y, kinds)), np.flatnonzero((size > 1) & np.isin(y, kinds))
        share = np.bincount(y[sure], weight[sure], len(KINDS))
        if not len(left) or (share[list(kinds)] == 0).any():
            continue
        even = (share.sum() / len(kinds) / np.maximum(share, 1e-9))[y[sure]]
        first = BoostedTrees(len(KINDS), rounds=20).fit(x[sure][:, view], y[sure], weight[sure] * even)
        p = (first.probabilities(x[left][:, view]) + 1e-6) * np.isin(np.arange(len(KINDS)), kinds)
        p[:, OTHER] *= np.where(ordinary[left], 1e6, DROPPED_MARK)
        p /= p.sum(1, keepdims=True)
        where = {at: i for i, at in enumerate(left)}
        for rows in forms.values():
            mine = [where[r] for r in rows if r in where]
            if mine:
                p[mine] = np.maximum(p[mine], LEAST * (p[mine] > 0)) * p[mine].mean(0) ** FORM_POWER
        y[left] = p.argmax(1)
    return y


class MarkupModel:
    """Boosted trees on the features of a node and on the kinds that nodes of its form had in the sample."""

    def __init__(self) -> None:
        self.trees, self.forms, self.mean = BoostedTrees(len(KINDS), columns=0.9), {}, np.zeros(len(KINDS))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, form: list[tuple]) -> "MarkupModel":
        hot = np.eye(len(KINDS))[y]
        self.mean = hot.mean(0)
        sums: dict[tuple, np.ndarray] = {}
        for f, h in zip(form, hot):
            sums[f] = sums.get(f, 0) + h
        self.forms = {f: (n + self.mean) / (n.sum() + 1) for f, n in sums.items()}
        share = np.bincount(y, weight, len(KINDS))
        self.trees.fit(self._with_forms(x, form), y, weight * np.sqrt(share.sum() / np.maximum(share, 1.0))[y])
        return self

    def _with_forms(self, x: np.ndarray, form: list[tuple]) -> np.ndarray:
        return np.concatenate([x, np.array([self.forms.get(f, self.mean) for f in form]).reshape(len(x), len(KINDS))], axis=1)

    def scores(self, x: np.ndarray, form: list[tuple] | None = None) -> np.ndarray:
        return self.trees.scores(self._with_forms(x, form or [()] * len(x)))


def fit(comments: list[tuple[str, str | None]]) -> "MarkupModel":
    """Boosted trees from pairs of marked-up and flattened text; see the head of the module."""
    x, sets, said, forms, plain = [], [], [], {}, set()
    for raw, flat in comments:
        nodes, seen = parse(raw), Flat(flat) if flat is not None else None
        for n, row in zip(nodes, features(raw, nodes)):
            left = seen.allowed(n, raw) if seen else ()
            if n.tag in NAMED and (not left or NAMED[n.tag] in left):
                left = (NAMED[n.tag],)
            if left == (OTHER,):
                plain.add(_letters(n.text))
            rows = forms.setdefault((*_form(n), left), []) if left else None
            if rows is not None and len(rows) < FORM_ROWS:
                rows.append(len(x))
                x.append(row)
                sets.append(left)
                said.append(_letters(n.text))
    if not x:
        return MarkupModel().fit(design([[0.0] * len(FEATURES)]), np.array([OTHER]), np.ones(1), [("line", "", 0, 1)])
    full = design(x)
    weight = np.empty(len(x))
    for rows in forms.values():  # rare forms count as if there were more of them
        weight[rows] = min(RARE_TIMES, FORM_WEIGHT / len(rows))
    y = _co_trained(full, sets, weight, forms, np.array([t in plain for t in said]))
    form = [()] * len(x)
    for key, rows in forms.items():
        for r in rows:
            form[r] = key[:-1]
    return MarkupModel().fit(full, y, weight, form)


def decode(nodes: list[Node], scores: np.ndarray) -> list[int]:
    """Kinds without contradictions: code and formula hold no further elements, nor does an element its own line."""
    kinds = scores.argmax(1).tolist() if len(nodes) else []
    for i, n in enumerate(nodes):  # parents come first
        p = n.parent
        if p < 0 or kinds[i] == OTHER:
            continue
        if kinds[p] in (CODE, FORMULA):
            kinds[i] = OTHER
        elif n.tag == "line" and n.attr == "inner" and kinds[p] in (HEADING, ITEM):
            kinds[i] = OTHER
        elif kinds[i] == kinds[p] == HEADING:
            kinds[i] = OTHER
    return kinds


_STRIP = [
    (re.compile(r"<!--.*?-->", re.S), ""), (re.compile(r"<ref\b[^>]*>.*?</ref>", re.S | re.I), ""), (re.compile(r"\{\{nowrap\|([^{}]*)\}\}"), r"\1"), (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"\[\[(?:[^\[\]|]*:)?(?:([^\[\]|]*)\|[^\[\]]*|([^\[\]|]*))\]\]"), r"\1\2"), (re.compile(r"\[https?://\S+ ([^\]]*)\]"), r"\1"), (re.compile(r"\[([^\]\n]*)\]\(https?://[^)\s]*\)"), r"\1"),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:emph|textbf|textit|texttt|section\*?|subsection\*?|subsubsection\*?|paragraph\*?)\{([^{}]*)\}"), r"\1"), (re.compile(r"\{\\(?:em|bf|it|tt) ([^{}]*)\}"), r"\1"),
    (re.compile(r"(?<!\\)%.*?$", re.M), ""), (re.compile(r"\\\\\s*$", re.M), ""), (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), ""), (re.compile(r"\\item\b ?"), ""), (re.compile(r"\\([$%&#_{}])"), r"\1"),
    (re.compile(r"'''?([^'\n]*)'''?"), r"\1"), (re.compile(r"\*\*([^*\n]+)\*\*"), r"\1"), (re.compile(r"~~([^~\n]+)~~"), r"\1"), (re.compile(r"(?<![\w*])\*([^*\s][^*\n]*)\*(?![\w*])"), r"\1"), (re.compile(r"(?<![\w_])_([^_\s][^_\n]*)_(?![\w_])"), r"\1"), (re.compile(r"`([^`\n]+)`"), r"\1"),
    (re.compile(r"</?[a-zA-Z][^<>]*>"), ""),
]


def _plain(text: str, latex: bool) -> str:
    for i, (pattern, to) in enumerate(_STRIP):
        if i in (10, 11) and not latex:
            continue
        text = pattern.sub(to, text)
    return html.unescape(text).replace("\xa0", " ").strip()


_CODE_SHELL = re.compile(r"\A(?:<[^<>]*>\s*?)+|(?:\s*?</[^<>]*>)+\Z|\A\s*(?:```|~~~)[^\n]*\n|\n?[ ]*(?:```+|~~~+)\s*\Z|\A\\begin\{[^{}]*\}(?:\[[^\]]*\])?\n?|\n?\\end\{[^{}]*\}\Z")
_MATH_SHELL = re.compile(r"\A(?:<[^<>]*>\s*)+|(?:\s*</[^<>]*>)+\Z|\A\\begin\{[^{}]*\}|\\end\{[^{}]*\}\Z")


_CONTAINERS = {"h", "li", "p", "div", "blockquote", "ul", "td"}


def render(raw: str, nodes: list[Node], kinds: list[int]) -> str:
    """Clean text: headings as ``# ``, list items as ``- ``, code between fences, formulas between dollar signs."""
    latex = _signs(raw)[3] > 0
    out: list[str] = []
    skip, last_end, pending = -1, 0, ""
    for n, k in zip(nodes, kinds):
        if n.start < skip:
            continue
        if k == CODE:
            body = _CODE_SHELL.sub("", n.text).strip("\n")
            out.append("```\n" + (html.unescape(body) if n.text.startswith("<") else body) + "\n```")
            skip = n.end
        elif k == FORMULA:
            body = _MATH_SHELL.sub("", n.text).strip()
            body = re.sub(r"\A(?:\$\$?|\\\[|\\\()|(?:\$\$?|\\\]|\\\))\Z", "", body).strip()
            formula = f"${html.unescape(body)}$"
            if n.tag in ("inline", "span", "math") and out and last_end and "\n" not in raw[last_end : n.start] and raw[max(0, n.start - 1) : n.start] not in ("\n", ">", ""):
                out[-1] += " " + formula
            else:
                out.append(formula)
            skip = n.end
        elif n.tag in ("h", "li") and k in (HEADING, ITEM):
            pending = "# " if k == HEADING else "- "
        elif n.tag not in _CONTAINERS:  # lines, and regions that are neither code nor formula: their text stays
            text = n.text if n.tag in ("line", "inline", "display") else _MATH_SHELL.sub("", _CODE_SHELL.sub("", n.text))
            text = _plain(_BREAK.sub("\n", text), latex)
            if k == HEADING:
                text = re.sub(r"\A\{([^{}]*)\}", r"\1", text).rstrip("#= ") if n.mark else text
            if not text:
                continue
            sign = "# " if k == HEADING else "- " if k == ITEM else pending
            joined = out and last_end and "\n" not in raw[last_end : n.start] and not _TAG.search(raw, last_end, n.start) and not sign
            if joined:
                out[-1] += " " + text
            else:
                out += [sign + text if i == 0 else text for i, text in enumerate(t.strip() for t in text.split("\n") if t.strip())]
            pending = ""
        last_end = n.end if n.tag not in _CONTAINERS else last_end
    return "\n".join(out)


def model(df: DataFrame, raw: str = "raw_comments", flat: str = "comments", sample_rows: int = SAMPLE_ROWS) -> MarkupModel:
    """Fitted in a task on at most ``sample_rows`` rows, the first by a hash of their ids over the whole table."""

    def run(batches):
        pairs = []
        for b in batches:
            for raws, flats in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flats = flats or []
                pairs += [(c, flats[i] if i < len(flats) else None) for i, c in enumerate(raws or ()) if c]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pairs))], pa.binary())], names=["model"])

    drawn = first_by_hash(df, sample_rows, "tbl", "row_id").select(F.col(raw).alias("raw"), F.col(flat).alias("flat"))
    fitted = drawn.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted[0]) if fitted else fit([])


def _kinds_of(trees: MarkupModel, comments: list[str]) -> tuple[list[list[Node]], list[list[int]]]:
    parsed = [parse(c) for c in comments]
    rows = [r for c, nodes in zip(comments, parsed) for r in features(c, nodes)]
    scores = trees.scores(design(rows), [_form(n) for nodes in parsed for n in nodes]) if rows else np.zeros((0, len(KINDS)))
    kinds, at = [], 0
    for nodes in parsed:
        kinds.append(decode(nodes, scores[at : at + len(nodes)]))
        at += len(nodes)
    return parsed, kinds


def elements(df: DataFrame, trees: MarkupModel, raw: str = "raw_comments") -> DataFrame:
    """``(tbl, row_id, comment_ix, kind, nth)``: one row per structural element, numbered per kind and comment.

    Null arrays and elements, empty texts and texts without markup give none.
    """

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                where, texts = [], []
                for i, cs in enumerate(part.column(2).to_pylist()):
                    for j, c in enumerate(cs or ()):
                        if c:
                            where.append((i, j))
                            texts.append(c)
                row, ix, kind, nth = [], [], [], []
                for (i, j), ks in zip(where, _kinds_of(trees, texts)[1]):
                    seen = [0] * len(KINDS)
                    for k in ks:
                        if k:
                            seen[k] += 1
                            row.append(i), ix.append(j), kind.append(KINDS[k]), nth.append(seen[k])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(ix, pa.int64()), pa.array(kind, pa.string()), pa.array(nth, pa.int64())], names=["tbl", "row_id", "comment_ix", "kind", "nth"])

    return df.select(F.col("tbl"), F.col("row_id").cast("bigint"), F.col(raw).alias("raw")).mapInArrow(run, "tbl string, row_id bigint, comment_ix bigint, kind string, nth bigint")


def clean(df: DataFrame, trees: MarkupModel, raw: str = "raw_comments") -> DataFrame:
    """``(tbl, row_id, texts)``: every row once; null comments stay null, empty ones empty."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                lists = part.column(2).to_pylist()
                texts = [c for cs in lists for c in cs or () if c]
                done = iter([render(c, n, k) for c, n, k in zip(texts, *_kinds_of(trees, texts))])
                out = [None if cs is None else [next(done) if c else c for c in cs] for cs in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.string()))], names=["tbl", "row_id", "texts"])

    return df.select(F.col("tbl"), F.col("row_id").cast("bigint"), F.col(raw).alias("raw")).mapInArrow(run, "tbl string, row_id bigint, texts array<string>")
