"""Plain text, Markdown and delimited tables."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.sources.units import Unit, decoded, units

LINES, CHARS, ROWS = 200, 64 * 1024, 200
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")
#: A heading of one to six marks.
HEADING = r"^\s*#{1,6}\s+.*$"


def plain_text(content, lines: int = LINES, chars: int = CHARS) -> Iterator[Unit]:
    """Runs of lines that close at a number of lines or characters; terminators are kept."""
    held, size, first, n = [], 0, 1, 0
    for m in _LINE.finditer(decoded(content)):
        n += 1
        held.append(m[0])
        size += len(m[0])
        if len(held) == lines or size >= chars:
            yield "text_lines", first, n, None, [], "".join(held)
            held, size, first = [], 0, n + 1
    if held:
        yield "text_lines", first, n, None, [], "".join(held)


def plain_units(rows: DataFrame, content: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return units(rows, plain_text, content, list(keys))


def markdown_sections(rows: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, section, first_line, last_line, text): a section for each heading, one more for what stands before the first.

    Lines are numbered and sections are running counts of headings, so the plan stays in the JVM.
    """
    lines = rows.select(key, F.posexplode(F.split(content, "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.sum(F.when(F.col("line").rlike(HEADING), 1).otherwise(0)).over(w))
    parts = F.sort_array(F.collect_list(F.struct("n", "line")))
    return marked.groupBy(key, "section").agg((F.min("n") + 1).alias("first_line"), (F.max("n") + 1).alias("last_line"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def column_letter(number: int) -> str:
    out = ""
    while number > 0:
        number, digit = divmod(number - 1, 26)
        out = chr(65 + digit) + out
    return out


def table_text(header: list[str], rows: list[list[str]]) -> str:
    """The labels above the rows, tab-joined; breaks inside a value are blanks."""
    return "".join("\t".join(re.sub(r"[\r\n]+", " ", c) for c in row) + "\n" for row in [header, *rows])


def csv_table(content, delimiter: str = ",", name: str = "table", rows_per_unit: int = ROWS) -> Iterator[Unit]:
    """Units of up to 200 rows that aren't blank, each under the header; rows keep the numbers a reader sees."""
    text = decoded(content).removeprefix("﻿")
    header: list[str] | None = None
    batch: list[tuple[int, list[str]]] = []

    def unit() -> Unit:
        body = [cells for _, cells in batch]
        width = max([len(header or []), 1, *map(len, body)])
        return "spreadsheet_range", batch[0][0], batch[-1][0], f"{name}!A{batch[0][0]}:{column_letter(width)}{batch[-1][0]}", [], table_text(header or [], body)

    for n, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
        if header is None:
            header = cells
        elif any(c.strip() for c in cells):
            batch.append((n, cells))
            if len(batch) == rows_per_unit:
                yield unit()
                batch = []
    if batch:
        yield unit()


def csv_units(rows: DataFrame, content: str = "content", keys: tuple[str, ...] = ("path",), delimiter: str = ",") -> DataFrame:
    return units(rows, lambda c: csv_table(c, delimiter), content, list(keys))
