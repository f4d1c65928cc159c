"""Word, spreadsheet and slide files of the zip-and-XML kind."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.sources.archive import SafeArchive, resolve
from stackroom.sources.text import ROWS, column_letter, table_text
from stackroom.sources.units import Refused, Unit, units

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
MOST_COLUMNS = 1024
#: Names of heading styles in several languages.
_STYLE = r"(?i)^(?:heading|rubrik|überschrift|titre)\s*([1-9])$"


def heading_level_of(name: Column) -> Column:
    """Level 1 to 9 by a heading style's name, else null."""
    level = F.regexp_extract(name, _STYLE, 1)
    return F.when(level != "", level.cast("int"))


def style_level(style_id: str | None, name: str | None, outline: int | None) -> int | None:
    """The outline level if there is one, else what the style's name or id says."""
    if outline is not None:
        return outline + 1 if 0 <= outline <= 8 else None
    for text in (name, style_id):
        if text and (m := re.match(_STYLE, text.strip())):
            return int(m[1])
    return None


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in raw:
        raise Refused("entities are not read")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Refused("not well-formed") from e


def _relations(archive: SafeArchive, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels".lstrip("/")
    if rels not in archive:
        return {}
    return {r.get("Id"): resolve(part, r.get("Target").lstrip("/")) if not r.get("Target").startswith("/") else r.get("Target").lstrip("/") for r in _xml(archive.read(rels)) if r.get("TargetMode") != "External"}


def sections(blocks: Iterator[tuple[int, str]]) -> Iterator[Unit]:
    """Blocks (heading level or 0, text) as units under heading paths, with their paragraphs' numbers."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    first, n = 1, 0

    def unit(last: int) -> Unit:
        names = [t for _, t in path]
        return "word_section", first, last, " › ".join(names) or None, names, "\n".join(held)

    for level, text in blocks:
        n += 1
        if level:
            if held:
                yield unit(n - 1)
            held, first = [], n
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, text))
        if text:
            held.append(text)
    if held:
        yield unit(n)


def word(content: bytes) -> Iterator[Unit]:
    archive = SafeArchive(content)
    names = {}
    if "word/styles.xml" in archive:
        for s in _xml(archive.read("word/styles.xml")).iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None

    def text_of(p) -> str:
        return "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in p.iter())

    def blocks() -> Iterator[tuple[int, str]]:
        body = _xml(archive.read("word/document.xml")).find(f"{_W}body")
        for x in body if body is not None else ():
            if x.tag == f"{_W}p":
                style, outline = x.find(f"{_W}pPr/{_W}pStyle"), x.find(f"{_W}pPr/{_W}outlineLvl")
                own = style.get(f"{_W}val") if style is not None else None
                text = text_of(x).strip()
                yield (style_level(own, names.get(own), int(outline.get(f"{_W}val")) if outline is not None else None) or 0) if text else 0, text
            elif x.tag == f"{_W}tbl":
                for row in x.iter(f"{_W}tr"):
                    yield 0, " | ".join(" ".join(text_of(p) for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc"))

    yield from sections(blocks())


def spreadsheet(content: bytes, rows_per_unit: int = ROWS) -> Iterator[Unit]:
    """A unit for up to 200 rows of a sheet under its first row; formulas give their stored results."""
    archive = SafeArchive(content)
    shared = []
    if "xl/sharedStrings.xml" in archive:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    links = _relations(archive, "xl/workbook.xml")
    for sheet in _xml(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        name, part = sheet.get("name"), links.get(sheet.get(f"{_R}id"))
        if part is None or part not in archive:
            continue
        header: list[str] | None = None
        batch: list[tuple[int, list[str]]] = []

        def unit(name=name) -> Unit:
            width = max([len(header or []), 1, *(len(c) for _, c in batch)])
            return "spreadsheet_range", batch[0][0], batch[-1][0], f"{name}!A{batch[0][0]}:{column_letter(width)}{batch[-1][0]}", [name], table_text(header or [], [c for _, c in batch])

        for n, row in enumerate(_xml(archive.read(part)).iter(f"{_S}row"), 1):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                ref = re.match(r"[A-Z]+", c.get("r") or "")
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(ref[0]))) - 1 if ref else len(cells)
                if at >= MOST_COLUMNS:
                    raise Refused("too many columns")
                value = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                cells += [""] * (at - len(cells)) + [text]
            if not any(x.strip() for x in cells):
                continue
            if header is None:
                header = cells
                continue
            batch.append((int(row.get("r") or n), cells))
            if len(batch) == rows_per_unit:
                yield unit()
                batch = []
        if batch or header and not batch:
            if not batch:
                continue
            yield unit()


def slides(content: bytes) -> Iterator[Unit]:
    """A unit for each slide with its notes; what the notes master says is left out."""
    archive = SafeArchive(content)
    links = _relations(archive, "ppt/presentation.xml")

    def lines(part: str) -> list[str]:
        return [t for p in _xml(archive.read(part)).iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())]

    for n, s in enumerate(_xml(archive.read("ppt/presentation.xml")).iter(f"{_P}sldId"), 1):
        part = links.get(s.get(f"{_R}id"))
        if part is None:
            continue
        own = lines(part)
        for other in _relations(archive, part).values():
            if "notesSlide" in other and other in archive:
                masters = [x for x in _relations(archive, other).values() if "notesMaster" in x and x in archive]
                common = {t for m in masters for t in lines(m)}
                own += [t for t in lines(other) if t not in common]
        yield "slide", n, n, None, [], "\n".join(own)


def office_units(rows: DataFrame, kind: str, content: str = "content", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return units(rows, {"docx": word, "xlsx": spreadsheet, "pptx": slides}[kind], content, list(keys))
