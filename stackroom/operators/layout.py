"""A page as an OCR engine lays it out (boxes of HTML with a label and a reading order) as structure."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stackroom.operators.structure import SCHEMA, Piece, place

#: Kinds by the engine's labels; any other label is a paragraph.
KINDS = {
    "SectionHeader": "heading", "Text": "paragraph", "Bibliography": "paragraph", "ListGroup": "list_item", "Table": "table", "Form": "table", "TableOfContents": "table", "Equation": "formula", "Code": "code",
    "Caption": "caption", "Footnote": "footnote", "PageHeader": "page_header", "PageFooter": "page_footer", "Picture": "figure", "Figure": "figure", "Diagram": "figure", "ChemicalBlock": "figure",
}
#: A heading without an element that tells its level.
LEVEL = 2
#: Fixed value: rows or columns that a cell may take.
MOST_SPAN = 1000
_EMPTY = {"br", "hr", "img", "input", "wbr", "col"}
#: What an element ends that wasn't closed.
_ENDS = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
_LINES = {"p", "div", "br", "hr", "li", "ul", "ol", "tr", "td", "th", "table", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "tbody", "thead"}


@dataclass
class Node:
    tag: str
    parent: Node | None = None
    inner: list[Node | str] = field(default_factory=list)
    attrs: dict[str, str | None] = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        for x in self.inner:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def raw(self, but: Iterable[Node] = ()) -> str:
        """All text as it stands, without some of the nodes."""
        return "".join(x if isinstance(x, str) else "" if any(x is n for n in but) else f" {x.raw(but)} " if x.tag in _LINES else x.raw(but) for x in self.inner)

    def text(self, but: Iterable[Node] = ()) -> str:
        return " ".join(self.raw(but).split())

    def inside(self, tag: str) -> Node | None:
        """The nearest element of this kind around it."""
        at = self.parent
        while at is not None and at.tag != tag:
            at = at.parent
        return at


class _Tree(HTMLParser):
    """The elements of a fragment; scripts and styles go, what isn't closed ends with what is around it."""

    def __init__(self, html: str):
        super().__init__()
        self.root = self.at = Node("")
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs) -> None:
        while self.at.tag in _ENDS.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, self.at, attrs=dict(attrs))
        self.at.inner.append(node)
        if tag not in _EMPTY:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at is not self.root and at.tag != tag:
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.at.inner.append(data)


def _around(node: Node, inner: Node) -> list[Node | str]:
    """The children of all elements that hold `inner`, in the page's order, with it among them."""
    holds = set()
    at = inner.parent
    while at is not None:
        holds.add(id(at))
        at = at.parent
    out: list[Node | str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and id(x) in holds:
            todo += reversed(x.inner)
        else:
            out.append(x)
    return out


def _number(value: str | None) -> int:
    """A span: a whole number from 1 to MOST_SPAN, else 1."""
    value = (value or "").strip()
    return min(max(int(value), 1), MOST_SPAN) if value.isascii() and value.removeprefix("-").removeprefix("+").isdigit() else 1


def grid(sizes: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """Where cells (rows and columns that each takes, row by row) stand: row, column, rows, columns; none on a place that is taken from above or the left."""
    free_from: dict[int, int] = {}  # for a column the first row in which it is free
    out = []
    for r, row in enumerate(sizes):
        c = 0
        for down, across in row:
            while free_from.get(c, 0) > r:
                c += 1
            out.append((r, c, down, across))
            free_from |= {k: r + down for k in range(c, c + across)}
            c += across
    return out


def _table(body: Node, label: str | None) -> tuple[list[Piece], bool]:
    """The first table with its cells' places, its caption before it, what stands around it as paragraphs; without cells a paragraph, which is odd under the label of a table."""
    table = next((n for n in body.walk() if n.tag == "table"), None)
    own = [n for n in table.walk() if n.inside("table") is table] if table else []
    cells = [[c for c in r.inner if isinstance(c, Node) and c.tag in ("th", "td")] for r in own if r.tag == "tr"]
    if not any(cells):
        return [Piece("paragraph", body.text())], label == "Table"
    rows = tuple(tuple((c.text(), c.tag == "th") for c in row) for row in cells)
    places = grid([[(_number(c.attrs.get("rowspan")), _number(c.attrs.get("colspan"))) for c in row] for row in cells])
    captions = [Piece("caption", n.text()) for n in own if n.tag == "caption"][:1]
    out: list[Piece] = []
    for x in _around(body, table):
        out += [*captions, Piece("table", rows=rows, spans=tuple(places))] if x is table else [Piece("paragraph", " ".join(x.split()) if isinstance(x, str) else x.text())]
    return out, False


def _parts(body: Node, tag: str) -> tuple[list[str], str]:
    """The texts of the outermost elements of a kind, and the text without them."""
    found = [n for n in body.walk() if n.tag == tag and n.inside(tag) is None]
    return [n.text() for n in found], body.text(found)


def _level(body: Node) -> int:
    marks = (n.tag for n in body.walk())
    return next((int(t[1]) for t in marks if t in {f"h{k}" for k in range(1, 7)}), LEVEL)


def read_block(html: str, label: str | None) -> tuple[list[Piece], bool]:
    """A block's pieces, and whether its shape couldn't be read (a table without cells)."""
    body, kind = _Tree(html).root, KINDS.get(label or "", "paragraph")
    if kind == "table":
        return _table(body, label)
    if kind == "list_item":
        items, rest = _parts(body, "li")
        return [Piece("paragraph", rest if items else ""), *(Piece(kind, t) for t in items or [rest])], False
    if kind == "formula":
        math, rest = _parts(body, "math")
        latex = "\n".join(t for t in math if t)
        return [Piece(kind, latex or body.text(), latex=latex or body.text()), Piece("paragraph", rest if latex else "")], False
    return [Piece(kind, body.raw().strip() if kind == "code" else body.text(), _level(body) if kind == "heading" else None)], False


def read_layout(blocks: list[tuple]) -> tuple[list[Piece], bool]:
    """Pieces of (html, label, reading order and, if known, box) in reading order, blocks without one last; pieces without text go, but for figures with a box.

    When a table's shape couldn't be read, the page is paragraphs only (True), and figures.
    """
    pieces, broken = [], False
    for html, label, _, *box in sorted(blocks, key=lambda b: (b[2] is None, b[2] or 0)):
        own, odd = read_block(html or "", label)
        broken |= odd
        where = tuple(box[0]) if box and box[0] is not None else None
        pieces += [replace(p, box=where) for p in own if p.text.strip() or any(c.strip() for row in p.rows for c, _ in row) or p.kind == "figure" and where]
    if broken:
        pieces = [p if p.kind == "figure" and not p.text.strip() else Piece("paragraph", p.text or "\n".join("\t".join(c for c, _ in r) for r in p.rows), box=p.box) for p in pieces]
    return pieces, broken


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("row", "column", "rows", "columns")])
BLOCKS = T.ArrayType(T.StructType([*SCHEMA.elementType.fields, T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("spans", T.ArrayType(_SPAN))]))


def layout_structured(pages: DataFrame, blocks: str = "layout", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, search_text, blocks (kind, start, end, level, box, a table's spans) and degraded of pages with an array of (html, label, reading_order and, if there is one, box)."""
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("search_text", T.StringType()), T.StructField("blocks", BLOCKS), T.StructField("degraded", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [read_layout([(b["html"], b["label"], b["reading_order"], b.get("box") if isinstance(b, dict) else None) for b in own] if own is not None else []) for own in pdf[blocks]]
            made = [place(p) for p, _ in read]
            yield pdf[list(keys)].assign(search_text=[t for t, _ in made], blocks=[[(b.kind, b.start, b.end, b.level, list(b.box) if b.box else None, [tuple(x) for x in b.spans] or None) for b in bs] for _, bs in made], degraded=[d for _, d in read])

    return pages.select(*keys, blocks).mapInPandas(run, schema)
