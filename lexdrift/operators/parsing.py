"""Parsers of stored pages: a tolerant tree of elements on the standard HTML parser, and what the forums need from it.

Pages come as ``(id, html)`` and are parsed in Arrow batches; a page that cannot be read gives no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end tag.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
TITLE_READ = re.compile(r"(?:Author\s+)?(?:Topic:)?\s*(.*?)\s*\(Read \d+ times?\)", re.S)


class Element:
    __slots__ = ("tag", "attrs", "children", "start", "end", "parent")

    def __init__(self, tag, attrs, start, parent=None):
        self.tag, self.attrs, self.start, self.parent = tag, attrs, start, parent
        self.children, self.end = [], start

    def classes(self):
        return set((self.attrs.get("class") or "").split())

    def walk(self):
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def find_all(self, tag=None, cls=None, id=None):
        wanted = set(cls.split()) if cls else set()
        for e in self.walk():
            if (tag is None or e.tag == tag) and wanted <= e.classes() and (id is None or e.attrs.get("id") == id):
                yield e

    def find(self, tag=None, cls=None, id=None):
        return next(self.find_all(tag, cls, id), None)

    def texts(self, skip=()):
        for c in self.children:
            if isinstance(c, Element):
                if c.tag not in skip:
                    yield from c.texts(skip)
            else:
                yield c

    def text(self, join="", skip=("script", "style")):
        return join.join(self.texts(skip))


class _Builder(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source, self.root = source, Element("", {}, 0)
        self.open = [self.root]
        self.starts = [0]
        for i, c in enumerate(source):
            if c == "\n":
                self.starts.append(i + 1)

    def _at(self):
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self._at(), self.open[-1])
        self.open[-1].children.append(e)
        e.end = e.start + len(self.get_starttag_text() or "")
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                close = self.source.find(">", self._at())
                for e in self.open[k:]:
                    e.end = close + 1 if close >= 0 else len(self.source)
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(source: str) -> Element:
    b = _Builder(source)
    b.feed(source)
    b.close()
    for e in b.open[1:]:
        e.end = len(source)
    return b.root


def page_text(source: str | None, drop=("code",)) -> str | None:
    """Text nodes joined by one blank, without the subtrees of ``drop``."""
    return None if source is None else tree(source).text(" ", skip=(*drop, "script", "style"))


def select(root: Element, path: str) -> list[Element]:
    """Elements by a path of steps ``tag.class.class#id``, each below the one before; ``>`` before a step takes children only."""
    found, children = [root], False
    for step in path.split():
        if step == ">":
            children = True
            continue
        tag, _, rest = step.partition("#") if "#" in step else step.partition(".")
        wanted = {"id": rest} if "#" in step else {"cls": rest.replace(".", " ")} if rest else {}
        below = []
        for e in found:
            kept = e.find_all(tag or None, **wanted)
            below += [x for x in kept if not children or x.parent is e]
        found, children = list(dict.fromkeys(below)), False
    return found


@dataclass(frozen=True)
class Source:
    """Where the parts of a page stand. Paths start at the first element of ``frame``; a page without it, or without what is required, is no page of this source."""

    frame: str
    title: str
    post: str
    body: str
    required: tuple[tuple[str, int], ...] = ()
    title_form: re.Pattern | None = None  # its first group is the title
    author: str = ""  # below the post
    left_out: str = ""  # areas without comments
    deleted: str = ""  # the text of a comment that is none
    dated_post: str = ""  # posts of the dated form, if they are others
    date: str = ""  # below the post
    date_line: int = 0  # which line of it
    date_tail: int = 0  # characters after the date
    date_format: str | None = None
    address: tuple[str, str] | None = None  # element and attribute of the page's own address
    trail: str = ""  # the trail to the page, whose last step is the page itself
    empty: str = ""  # without this element the page is one of no posts


# Elements and date formats of the pages of three kinds of sources.
SOURCES = {
    "board": Source(
        frame="div#content", title="div.navigation span", required=(("div.navigation a", 3), ("div.navigation span", 1), ("div#posts", 1)), post="div#posts", body="div.post_body",
        author="td.post_author span.largetext", dated_post="div#posts .tborder", date=".tcat div.float_left.smalltext", date_format="MM-dd-yyyy, hh:mm a",
    ),
    "links": Source(frame="", title="a.title", required=(("a.title", 1),), post="", body="div.usertext-body", left_out="div.side", deleted="[deleted]"),
    "market": Source(
        frame="div#main_content_section", title="div#forumposts div.cat_bar", title_form=TITLE_READ, required=(("div.navigate_section", 1),), empty="div#forumposts", post="div#forumposts form#quickModForm > div",
        body="div.post", author="div.poster h4", date="div.flow_hidden div.smalltext", date_line=-1, date_tail=1, date_format="MMMM dd, yyyy, hh:mm a",
        address=("div#forumposts form#quickModForm", "action"), trail="div.navigate_section",
    ),
}


def parse_page(source: str, kind: str, dated: bool = False) -> dict | None:
    """Title, authors, raw comments and, if ``dated``, the dates as written of a page; None for pages of other kinds."""
    s, root = SOURCES[kind], tree(source)
    frame = next(iter(select(root, s.frame)), None) if s.frame else root
    if frame is None or any(len(select(frame, path)) < least for path, least in s.required):
        return None
    out = {"title": "", "authors": [], "raw_comments": [], "dates": [], "url": None, "category": []}
    if s.trail:
        out["category"] = [x.strip() for x in select(frame, s.trail)[0].text(" ").split("»")][:-1]
    if s.empty and not select(frame, s.empty):
        return out
    heads = [e.text(" ").strip() if s.title_form is None else e.text().strip() for e in select(frame, s.title)[:1]]
    if s.title_form:
        heads = [m.group(1) for h in heads if (m := s.title_form.match(h))]
    if not heads or s.address and not select(frame, s.address[0]):
        return None
    out["title"] = heads[0]
    if s.address:
        out["url"] = select(frame, s.address[0])[0].attrs.get(s.address[1])
    aside = {id(x) for e in select(frame, s.left_out)[:1] for x in e.walk()} if s.left_out else set()
    everywhere = select(frame, s.post) if s.post else [frame]
    out["authors"] = sorted({a.text().strip() for p in everywhere for a in (select(p, s.author) if s.author else [])})
    for post in select(frame, s.dated_post) if dated and s.dated_post else everywhere:
        said = [e.text("\n").strip().split("\n")[s.date_line] for e in select(post, s.date)[:1]] if dated and s.date else []
        if dated and s.date and not said:
            continue
        for e in select(post, s.body):
            if id(e) not in aside and not (s.deleted and e.text(" ").strip() == s.deleted):
                out["raw_comments"].append(source[e.start : e.end])
                out["dates"] += [t[: len(t) - s.date_tail].strip() for t in said]
    return out


def _field(name: str):
    return lambda p: p[name]  # of one parameter: a second one would be the place in the array


def parse_pages(pages: DataFrame, kind: str, key: str = "id", dated: bool = False) -> DataFrame:
    """``(key, title, authors, raw_comments, comments, dates)`` of pages ``(key, html)``; posts whose date cannot be read are dropped when ``dated``."""
    form = SOURCES[kind].date_format

    def run(batches):
        for b in batches:
            rows = []
            for k, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = parse_page(source, kind, bool(dated and form)) if source else None
                if page:
                    rows.append((k, page["title"], page["authors"], page["raw_comments"], [page_text(c) for c in page["raw_comments"]], page["dates"]))
            cols = list(zip(*rows)) or [[]] * 6
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), texts, texts, texts, texts))], names=["id", "title", "authors", "raw_comments", "comments", "said"])

    parsed = pages.select(F.col(key).cast("string").alias("id"), "html").mapInArrow(run, "id string, title string, authors array<string>, raw_comments array<string>, comments array<string>, said array<string>")
    if not (dated and form):
        return parsed.drop("said")
    posts = F.filter(F.arrays_zip("raw_comments", "comments", F.transform("said", lambda s: F.try_to_timestamp(s, F.lit(form))).alias("dates")), lambda p: p["dates"].isNotNull())
    return parsed.withColumn("p", posts).select("id", "title", "authors", *(F.transform("p", _field(f)).alias(f) for f in ("raw_comments", "comments", "dates")))


def html_texts(rows: DataFrame, column: str) -> DataFrame:
    """The array column of HTML replaced by its texts; null elements stay null."""
    at = rows.columns.index(column)

    def run(batches):
        for b in batches:
            texts = [None if cs is None else [page_text(c) for c in cs] for cs in b.column(at).to_pylist()]
            yield b.set_column(at, column, pa.array(texts, pa.list_(pa.string())))

    return rows.mapInArrow(run, rows.schema)
