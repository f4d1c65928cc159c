"""A page's structure: blocks read from Markdown, their text with ranges, and spans of it as Markdown again."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stackroom.operators.corrections import Edit
from stackroom.sources.units import search_form


@dataclass(frozen=True)
class Piece:
    """A block before it has a place: its kind, text, and for a table its rows of (text, header).

    `kind` is one of heading, paragraph, list_item, table, formula, code, caption, footnote, figure,
    page_header and page_footer.
    """

    kind: str
    text: str = ""
    level: int | None = None
    latex: str | None = None
    rows: Sequence[tuple[tuple[str, bool], ...]] = ()
    spans: tuple[tuple[int, int, int, int], ...] = ()
    box: tuple[float, ...] | None = None


@dataclass(frozen=True)
class Cell:
    start: int
    end: int
    header: bool = False


class PlainRows(Sequence):
    """A table's rows of (text, header), made when they are asked for: `text` has them on lines, in search form and cells between tabs; the first is the header."""

    def __init__(self, text: str):
        self.text = text

    def __iter__(self) -> Iterator[tuple]:
        for k, line in enumerate(self.text.split("\n")):
            yield tuple((c, k == 0) for c in line.split("\t"))

    def __len__(self) -> int:
        return self.text.count("\n") + 1

    def __getitem__(self, k):
        return tuple(self)[k]

    def __eq__(self, other) -> bool:
        return tuple(self) == tuple(other) if isinstance(other, Sequence) else NotImplemented

    def __hash__(self) -> int:
        return hash(tuple(self))


class PlacedRows(PlainRows):
    """The same rows as ranges of cells, counted from where the table begins."""

    def __init__(self, text: str, start: int):
        super().__init__(text)
        self.start = start

    def __iter__(self) -> Iterator[tuple]:
        at = self.start
        for row in super().__iter__():
            cells = []
            for c, h in row:
                cells.append(Cell(at, at + len(c), h))
                at += len(c) + 1
            yield tuple(cells)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Where rows begin and end."""
        codes = np.frombuffer(self.text.encode("ascii"), np.uint8)
        breaks = np.flatnonzero(codes == 10) + self.start
        return np.concatenate([[self.start], breaks + 1]), np.concatenate([breaks, [self.start + len(codes)]])


@dataclass(frozen=True)
class Block:
    """A block's range in the page's search text (empty for a figure without words); a table's rows are ranges of cells."""

    kind: str
    start: int
    end: int
    level: int | None = None
    latex: str | None = None
    rows: Sequence[tuple[Cell, ...]] = field(default=())
    spans: tuple[tuple[int, int, int, int], ...] = ()
    box: tuple[float, ...] | None = None


# reading Markdown: rules in order of precedence; each says which pieces begin at a line and which line is next, or None


def _bare(line: str) -> str | None:
    """The line without its indentation, unless it is indented so far that no mark counts."""
    rest = line.lstrip(" ")
    return rest if len(line) - len(rest) < 4 else None


def _lead(text: str, mark: str) -> int:
    """How often a character stands at the beginning."""
    return len(text) - len(text.lstrip(mark))


def _without(text: str, mark: str, between_words: bool = False, one_line: bool = True) -> str:
    """The text without pairs of a mark; with between_words, a mark inside a word is none."""
    out, at = "", 0
    while (s := text.find(mark, at)) >= 0 and (e := text.find(mark, s + len(mark) + 1)) >= 0:
        inner, end = text[s + len(mark) : e], e + len(mark)
        fits = not (one_line and "\n" in inner)
        if between_words:
            outer = text[s - 1 : s] + text[end : end + 1]
            fits = fits and inner == inner.strip() and not any(c.isalnum() or c == "_" for c in outer)
        out += text[at:s] + (inner if fits else mark)
        at = end if fits else s + len(mark)
    return out + text[at:]


def _plain(text: str) -> str:
    if not ("*" in text or "_" in text or "`" in text):
        return text
    for mark in ("**", "__", "_", "`"):
        text = _without(text, mark, mark.startswith("_"), mark != "`")
    return text


def _cells(line: str) -> list[str]:
    """Cells between pipes; a backslash before a pipe makes it part of its cell."""
    line = line.strip()
    if "\\" not in line:
        cells = [c.strip() for c in line.removeprefix("|").split("|")]
        return cells[:-1] if cells[-1] == "" and len(cells) > 1 else cells
    cells, own = [], ""
    for k, c in enumerate(line):
        if c != "|":
            own += c
        elif own.endswith("\\"):
            own = own[:-1] + "|"
        elif k:  # one at the very beginning is an edge
            cells.append(own.strip())
            own = ""
    return cells if own == "" and cells else [*cells, own.strip()]


def _is_rule(cell: str) -> bool:
    return cell.count("-") > 0 and set(cell.removeprefix(":").removesuffix(":")) == {"-"}


def _some(kind: str, text: str, **more) -> list[Piece]:
    return [Piece(kind, text, **more)] if text.strip() else []


def _region(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    """A marked page header or footer: paragraphs of its own kind, then what follows its end on the line."""
    bare = lines[i].strip()
    for name in ("page-header", "page-footer"):
        begin, stop = f"<!-- {name} -->", f"<!-- /{name} -->"
        if bare == stop:
            return [], i + 1
        if not bare.startswith(begin):
            continue
        first = bare[len(begin) :]
        for k in range(i, len(lines)):
            inner, found, after = (first if k == i else lines[k]).partition(stop)
            if found:
                body = [inner] if k == i else [first, *lines[i + 1 : k], inner]
                parts, own = [], []
                for line in [*body, ""]:
                    if line.strip():
                        own.append(line)
                    else:
                        parts += _some(name.replace("-", "_"), _plain("\n".join(own).strip()))
                        own = []
                return parts + _some("paragraph", _plain(after.strip())), k + 1
        return _some("paragraph", _plain(first.strip())), i + 1
    return None


def _fenced(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    bare = _bare(lines[i])
    mark = bare[:1] if bare else ""
    if mark not in ("`", "~") or (n := _lead(bare, mark)) < 3:
        return None
    end = i + 1
    while end < len(lines) and not (len(lines[end].strip()) >= n and set(lines[end].strip()) == {mark}):
        end += 1
    return [Piece("code", "\n".join(lines[i + 1 : end]))], end + 1


def _heading(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    bare = _bare(lines[i]) or ""
    level = _lead(bare, "#")
    if not 1 <= level <= 6 or bare[level:].strip(" \t") and bare[level] not in " \t":
        return None
    text = bare[level:].strip(" \t")
    ended = text.rstrip("#")
    if ended != text and ended[-1:] in (" ", "\t"):
        text = ended.rstrip(" \t")
    return _some("heading", _plain(text), level=level), i + 1


def _formula(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    bare = lines[i].strip()
    if bare.startswith("$$"):
        for k in range(i, len(lines)):
            own = lines[k].strip()
            if not own:
                break
            if own.endswith("$$") and (k > i or len(own) > 3):
                latex = "\n".join(x.strip() for x in lines[i : k + 1])[2:-2].strip()
                return [Piece("formula", latex, latex=latex)], k + 1
        return None
    if len(bare) > 2 and bare[0] == bare[-1] == "$" and "$" not in bare[1:-1]:
        latex = bare[1:-1].strip()
        return [Piece("formula", latex, latex=latex)], i + 1
    return None


def _table(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    """A line of cells over a line of as many rules, and the lines with pipes that follow."""
    if "|" not in lines[i] or i + 1 == len(lines):
        return None
    head, rules = _cells(lines[i]), _cells(lines[i + 1])
    if len(head) != len(rules) or not all(map(_is_rule, rules)):
        return None
    end = i + 2
    while end < len(lines) and "|" in lines[end]:
        end += 1
    own = [lines[i], *lines[i + 2 : end]]
    if (rows := _plain_rows(own)) is not None:
        return [Piece("table", rows=rows)], end
    rows = map(_cells, own)
    return [Piece("table", rows=tuple(tuple((_plain(c), k == 0) for c in row) for k, row in enumerate(rows)))], end


def _plain_rows(lines: list[str]) -> PlainRows | None:
    """The rows of lines of printable ASCII without escapes and marks, all read at once; None for others."""
    text = "\n" + "\n".join(lines) + "\n"
    if not text.isascii() or any(c in text for c in "\\*_`") or not text.replace("\n", "").isprintable():
        return None
    text = text.replace(" | ", "|").replace("| ", "|").replace(" |", "|")  # most of the blanks at once
    if any(x in text for x in ("| ", " |", "\n ", " \n")):
        text = "\n".join([x.strip(" ") for x in text.split("\n")])
        text = "|".join([c.strip(" ") for c in text.split("|")])
    return PlainRows(text.replace("\n|", "\n").replace("|\n", "\n")[1:-1].replace("|", "\t"))  # a pipe at a line's beginning or end is an edge


def _item(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    """A bullet's text; a numbered item keeps its number."""
    bare = _bare(lines[i]) or ""
    mark = bare.split(None, 1)[0] if bare else ""
    if bare[len(mark) : len(mark) + 1] not in (" ", "\t"):
        return None
    text = bare[len(mark) :].strip()
    if mark in ("-", "*", "+"):
        return _some("list_item", _plain(text)), i + 1
    if mark[-1:] in (".", ")") and len(mark) <= 10 and mark[:-1].isascii() and mark[:-1].isdigit():
        return _some("list_item", _plain(f"{mark} {text}".strip())), i + 1
    return None


def _blank(lines: list[str], i: int) -> tuple[list[Piece], int] | None:
    return None if lines[i].strip() else ([], i + 1)


_RULES = (_blank, _region, _fenced, _heading, _formula, _table, _item)


def read_markdown(markdown: str) -> list[Piece]:
    """Blocks in order: fences, headings, formulas, pipe tables, list items, marked page headers and footers, paragraphs."""
    lines, out, prose, i = markdown.split("\n"), [], [], 0
    while i < len(lines):
        found = next((x for rule in _RULES if (x := rule(lines, i)) is not None), None)
        if found is None:
            prose.append(lines[i])
            i += 1
            continue
        out += _some("paragraph", _plain("\n".join(prose).strip())) + found[0]
        prose, i = [], found[1]
    return out + _some("paragraph", _plain("\n".join(prose).strip()))


# placing blocks


def place(pieces: list[Piece]) -> tuple[str, list[Block]]:
    """The page's search text (blocks on lines of their own, cells between tabs) and the blocks' ranges in it."""
    text, blocks = "", []
    for p in pieces:
        plain = p.rows if p.kind == "table" and isinstance(p.rows, PlainRows) else None
        grid = [[(search_form(c), h) for c, h in row] for row in p.rows] if p.kind == "table" and p.rows and plain is None else None
        own = plain.text if plain else "\n".join("\t".join(c for c, _ in row) for row in grid) if grid else search_form(p.text)
        if not own.strip():
            if p.kind == "figure" and p.box:
                blocks.append(Block(p.kind, len(text), len(text), box=p.box))
            continue
        text += "\n" if text else ""
        start = len(text)
        rows = []
        at = start
        for row in grid or ():
            cells = []
            for c, h in row:
                cells.append(Cell(at, at + len(c), h))
                at += len(c) + 1
            rows.append(tuple(cells))
        text += own
        blocks.append(Block(p.kind, start, len(text), min(max(p.level, 1), 6) if p.level and p.kind == "heading" else None, p.latex if p.kind == "formula" else None, PlacedRows(own, start) if plain else tuple(rows), p.spans, p.box))
    return text, blocks


def window(blocks: list[Block], first: int, last: int) -> list[Block]:
    """Blocks that reach into [first, last), clamped to it and counted from it."""
    clamp = lambda x: min(max(x, first), last) - first
    cut = [replace(b, start=clamp(b.start), end=clamp(b.end), rows=tuple(tuple(replace(c, start=clamp(c.start), end=clamp(c.end)) for c in r) for r in b.rows)) for b in blocks if b.start < last and b.end > first]
    return [b for b in cut if b.start < b.end]


def correct_blocks(text: str, blocks: list[Block], edits: list[Edit]) -> tuple[str, list[Block], bool]:
    """Text and blocks after edits; where an edit crosses a block's or cell's edge the page becomes plain paragraphs (True)."""
    edges = sorted({x for b in blocks for r in (b, *(c for row in b.rows for c in row)) for x in (r.start, r.end)})
    crossed = any(e.start < x < e.end for e in edits for x in edges)
    out, at = "", 0
    for e in edits:
        out += text[at : e.start] + e.replacement
        at = e.end
    out += text[at:]
    if crossed or any("\n" in e.replacement or "\t" in e.replacement for e in edits) and any(b.rows for b in blocks):
        return (*place([Piece("paragraph", line) for line in out.split("\n")]), True)

    def moved(x: int, is_end: bool) -> int:
        d = sum(len(e.replacement) - (e.end - e.start) for e in edits if e.end <= x and (is_end or e.end > e.start or e.start < x))
        return x + d

    shift = lambda r: replace(r, start=moved(r.start, False), end=moved(r.end, True))
    return out, [replace(shift(b), rows=tuple(tuple(map(shift, r)) for r in b.rows)) for b in blocks], False


# rendering spans


def render(blocks: list[Block], text: str, first: int, last: int) -> str:
    """The span [first, last) as Markdown: marks only where a block begins in it, tables under their header row."""
    parts: list[tuple[str | None, str]] = []
    at = first
    inside = sorted((b for b in blocks if b.start < last and b.end > first), key=lambda b: b.start)
    if not inside:
        return text[first:last]
    for b in inside:
        s, e = max(b.start, first), min(b.end, last)
        if text[at:s].strip():
            parts.append((None, text[at:s].strip()))
        at = e
        if b.kind in ("page_header", "page_footer"):
            continue
        own = _render_table(b, text, first, last) if b.kind == "table" else _render_text(b, text[s:e], b.start >= first, b.end <= last)
        if own:
            parts.append((b.kind, own))
    if text[at:last].strip():
        parts.append((None, text[at:last].strip()))
    out, before = "", None
    for kind, own in parts:
        out += ("" if not out else "\n" if before == kind == "list_item" else "\n\n") + own
        before = kind
    return out


def _render_text(b: Block, own: str, begins: bool, ends: bool) -> str | None:
    if not own.strip():
        return None
    if b.kind == "heading" and begins:
        return "#" * (b.level or 1) + " " + own
    if b.kind == "list_item" and begins:
        return "- " + own
    if b.kind == "formula" and b.latex is not None and begins and ends:
        return f"${b.latex}$"
    if b.kind == "code":
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", own)), default=0))
        return f"{fence}\n{own}\n{fence}"
    return own


def _render_table(b: Block, text: str, first: int, last: int) -> str | None:
    rows = [r for r in b.rows if r]
    reached = [r for r in rows if any(c.start < last and c.end > first for c in r)]
    if not reached:
        return None
    head = next((r for r in rows if any(c.header for c in r)), rows[0])
    width = max(map(len, rows))
    clean = lambda a, z: text[a:z].replace("\n", " ").replace("|", "\\|").strip() if a < z else ""
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    body = [line([clean(max(c.start, first), min(c.end, last)) for c in r]) for r in reached if r is not head]
    return "\n".join([line([clean(c.start, c.end) for c in head]), line(["---"] * width), *body])


SCHEMA = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("level", T.IntegerType())]))


_RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
WITH_ROWS = T.ArrayType(T.StructType([*SCHEMA.elementType.fields, T.StructField("rows", T.ArrayType(_RANGE))]))


def structured(pages: DataFrame, content: str = "markdown", keys: tuple[str, ...] = ("page_id",), rows: bool = False) -> DataFrame:
    """keys, search_text and blocks (kind, start, end, level; with rows, a table's rows as ranges, too) of pages in Markdown."""
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("search_text", T.StringType()), T.StructField("blocks", WITH_ROWS if rows else SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [place(read_markdown(m or "")) for m in batch.column(content).to_pylist()]
            columns = [*(batch.column(k) for k in keys), pa.array([t for t, _ in made], pa.string()), _block_lists([bs for _, bs in made], rows)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*keys, content).mapInArrow(run, schema)


def row_ranges(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where a table's rows begin and end."""
    if isinstance(b.rows, PlacedRows):
        return b.rows.ranges()
    return np.array([r[0].start for r in b.rows if r], np.int64), np.array([r[-1].end for r in b.rows if r], np.int64)


def _block_lists(pages: list[list[Block]], rows: bool) -> pa.ListArray:
    """A list of each page's blocks, as SCHEMA or WITH_ROWS has them."""
    ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    blocks = [b for bs in pages for b in bs]
    fields = {"kind": pa.array([b.kind for b in blocks], pa.string()), "start": pa.array([b.start for b in blocks], pa.int32()), "end": pa.array([b.end for b in blocks], pa.int32()), "level": pa.array([b.level for b in blocks], pa.int32())}
    if rows:
        own = [row_ranges(b) for b in blocks]
        flat = [pa.array(np.concatenate([np.zeros(0, np.int32), *(x[k] for x in own)]).astype(np.int32)) for k in (0, 1)]
        fields["rows"] = pa.ListArray.from_arrays(ends([len(x[0]) for x in own]), pa.StructArray.from_arrays(flat, names=["start", "end"]))
    return pa.ListArray.from_arrays(ends([len(bs) for bs in pages]), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
