"""HTML pages as sections under their headings, with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from stackroom.sources.units import Refused, Unit, decoded, units

MOST_BYTES = 32 << 20
#: Elements whose content is dropped, blocks whose text is a line of its own, elements without an end.
DROPPED = {"script", "style", "iframe", "object", "embed", "noscript", "template", "svg", "math", "canvas", "audio", "video", "applet", "head"}
BLOCKS = {
    "body", "div", "p", "section", "article", "main", "header", "footer", "aside", "nav", "figure", "figcaption", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tr", "td", "th",
    "blockquote", "pre", "address", "summary", "details", "fieldset", "legend", "form",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADING = re.compile(r"h([1-6])")


class _Node:
    __slots__ = ("has_heading", "level", "parts", "tag")

    def __init__(self, tag: str):
        m = _HEADING.fullmatch(tag)
        self.tag, self.parts, self.level, self.has_heading = tag, [], int(m[1]) if m else 0, False


class _Page(HTMLParser):
    """Entries in document order: (level, title) for headings, (0, text) for blocks.

    A block's whole text is one entry unless it holds a heading; then its inner blocks and its own text are.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("body")
        self.stack = [self.root]
        self.skip: list[str] = []
        self.title, self.lang = "", None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.lang = dict(attrs).get("lang") or self.lang
        if tag == "title":
            self.in_title = True
        if tag in DROPPED and tag not in VOID:
            self.skip.append(tag)
        if self.skip:
            return
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID or tag in ("html", "body"):
            return
        if tag in BLOCKS or _HEADING.fullmatch(tag):
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and self.stack[-1].tag == tag:
                self._close()
            node = _Node(tag)
            self.stack[-1].parts.append(node)
            self.stack.append(node)
            if node.level:
                for up in self.stack[:-1]:
                    up.has_heading = True

    def _close(self):
        if len(self.stack) > 1:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.stack[-1].parts.append(data)


def _text(node: _Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(" ")
            todo += [" ", *reversed(x.parts)]
    return " ".join("".join(out).split())


def _entries(node: _Node) -> Iterator[tuple[int, str]]:
    if node.level:
        yield node.level, _text(node)
    elif not node.has_heading:
        if text := _text(node):
            yield 0, text
    else:
        own = " ".join(" ".join(x for x in node.parts if isinstance(x, str)).split())
        if own:
            yield 0, own
        for x in node.parts:
            if isinstance(x, _Node):
                yield from _entries(x)


def parse_page(content) -> _Page:
    if len(content) > MOST_BYTES:
        raise Refused("document too large")
    page = _Page()
    page.feed(decoded(content))
    page.close()
    return page


def html_sections(content) -> Iterator[Unit]:
    """A unit for each run of text under one heading path."""
    path: list[tuple[int, str]] = []
    texts: list[str] = []

    def unit() -> Unit:
        names = [t for _, t in path]
        return "html_section", None, None, " › ".join(names) or None, names, "\n".join(texts)

    for level, text in _entries(parse_page(content).root):
        if level:
            if texts:
                yield unit()
            texts = []
            if text:
                while path and path[-1][0] >= level:
                    path.pop()
                path.append((level, text))
                texts = [text]
        else:
            texts.append(text)
    if texts:
        yield unit()


def html_units(rows: DataFrame, content: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return units(rows, html_sections, content, list(keys))
