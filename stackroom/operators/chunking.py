"""Token-bounded, overlapping chunks of units.

A chunk's budget holds a passage prefix, special tokens and, for tables, a repeated header. Tokens'
places are found once for each unit, so a boundary is an index into them instead of a search.
Offsets are code points of the unit's search text.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.operators import structure

BUDGET, OVERLAP = 512, 100
PREFIX, SPECIAL = 2, 1
OVERHEAD = PREFIX + SPECIAL

Spans = list[tuple[int, int]]
Tokenizer = Callable[[str], Spans]
_TOKEN = re.compile(r"\S+")
#: Which code points are white space; the last one stands for all beyond.
_SPACE = np.array([*(chr(c).isspace() for c in range(0x3001)), False])
#: A structured page's running parts, as they are called here.
_PAGE_PARTS = {"page_header": "header", "page_footer": "footer"}


def whitespace_tokens(text: str) -> Spans:
    """Places of runs without white space: the default counter, as no tokenizer file is assumed."""
    return [m.span() for m in _TOKEN.finditer(text)]


def _places(text: str) -> tuple[list[int], list[int]]:
    """Where the tokens of whitespace_tokens begin and end, found for a long text at once."""
    space = _SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_SPACE) - 1)]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True)).tolist()
    return edges[::2], edges[1::2]


def is_searchable(text: str) -> bool:
    """A letter or digit is there, and the text isn't the lone artefact of a doubled encoding."""
    return any(c.isalpha() or c.isdecimal() for c in text) and text.strip() != "Â"


@dataclass(frozen=True)
class Block:
    """A block of a structured page; rows (start, end) for tables, the first being the header."""

    start: int
    end: int
    kind: str = "paragraph"
    rows: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class Chunk:
    ordinal: int
    text: str
    start: int
    end: int
    tokens: int


class _Text:
    """A unit's text with its tokens' places."""

    def __init__(self, text: str, tokenize: Tokenizer):
        self.text = text
        if tokenize is whitespace_tokens:
            self.begin, self.end = _places(text)
        else:
            spans = tokenize(text)
            self.begin, self.end = [a for a, _ in spans], [b for _, b in spans]

    def count(self, a: int, b: int) -> int:
        """Tokens that reach into [a, b)."""
        return max(bisect.bisect_left(self.begin, b) - bisect.bisect_right(self.end, a), 0)

    def furthest(self, a: int, to: int, most: int) -> int:
        """The last end with no more than so many tokens; a where not even one fits."""
        if most < 1:
            return a
        k = bisect.bisect_right(self.end, a) + most
        return min(self.begin[k], to) if k < len(self.begin) else to

    def starts(self, a: int, b: int) -> list[int]:
        """Where the tokens of [a, b) begin within it."""
        i, j = bisect.bisect_right(self.end, a), bisect.bisect_left(self.begin, b)
        return [max(x, a) for x in self.begin[i:j]]


def chunk_text(text: str, header: str | None = None, blocks: list[Block] | None = None, budget: int = BUDGET, overlap: int = OVERLAP, tokenize: Tokenizer = whitespace_tokens) -> tuple[list[Chunk], bool]:
    """Chunks of a unit, and whether a header was dropped because no body fits beside it.

    Each end is the furthest that fits, moved back to a structural boundary (blocks, table rows) or
    else to the last line break, if half the body budget is kept; each start lies `overlap` tokens
    before the end, one character on at least. Chunks without a word go, ordinals close up.
    """
    if budget <= 0 or not 0 <= overlap < budget:
        raise ValueError("an overlap is smaller than the budget")
    if not is_searchable(text):
        return [], False
    unit = _Text(text, tokenize)
    size = functools.cache(lambda h: len(tokenize(h)) if h else 0)
    usable = lambda h: h is not None and size(h) <= budget - OVERHEAD - 1
    dropped = False
    found: list[tuple[str, int, int, int]] = []

    def walk(first: int, to: int, header_at: Callable[[int], str | None], ends: Callable[[int, int, int, int], int | None]) -> None:
        start, reached = first, first
        while start < to:
            own = header_at(start)
            body = budget - OVERHEAD - size(own)
            limit = unit.furthest(start, to, body)
            floor = max(start, reached)
            if limit <= start or blocks is not None and limit >= to:
                end = to
            else:
                end = ends(start, limit, floor, body) if blocks is not None else None
                if end is None:
                    brk = text.rfind("\n", floor + 1, limit)
                    end = brk if brk > floor and body // 2 <= unit.count(start, brk) <= body else limit
            found.append(((own or "") + text[start:end], start, end, OVERHEAD + size(own) + unit.count(start, end)))
            if end >= to:
                return
            reached, before = end, start
            starts = unit.starts(start, end) if overlap else []
            start = end if not overlap or len(starts) + size(own) <= overlap or len(starts) < overlap else max(before + 1, starts[-overlap])
            if blocks is not None and start < end:
                at = bisect.bisect_right(edges, start) - 1
                if at >= 0 and before < edges[at] < start and unit.furthest(edges[at], to, budget - OVERHEAD - size(header_at(edges[at]))) > end:
                    start = edges[at]

    if blocks is None:
        repeated = header if usable(header) else None
        dropped = header is not None and repeated is None
        walk(0, len(text), lambda _: repeated, lambda *_: None)
    else:
        edges = sorted({b.start for b in blocks} | {r[0] for b in blocks for r in b.rows}) if overlap else []  # asked for only where a chunk begins before the last one's end
        tables = [b for b in blocks if b.kind == "table" and b.rows]
        # found by bisection: a long table is not gone through again for each of its chunks
        block_ends = sorted(b.end for b in blocks)
        rows = [r for b in tables for r in b.rows]
        row_ends = sorted(r[1] for r in rows)
        highest = list(itertools.accumulate((r[0] for r in rows), max))  # the first row from a place on is where this reaches it

        def header_at(at: int) -> str | None:
            nonlocal dropped
            own = next((b for b in tables if b.start <= at < b.end), None)
            if own is None or at < own.rows[0][1]:
                return None
            h = text[own.rows[0][0] : own.rows[0][1]] + "\n"
            dropped |= not usable(h)
            return h if usable(h) else None

        def last(places: list[int], floor: int, limit: int) -> int | None:
            k = bisect.bisect_right(places, limit)
            return places[k - 1] if k and places[k - 1] > floor else None

        def ends(start: int, limit: int, floor: int, body: int) -> int | None:
            worth = lambda e: body // 2 <= unit.count(start, e) <= body
            block = last(block_ends, floor, limit)
            if block is not None and worth(block):
                return block
            row = last(row_ends, floor, limit)
            if row is None or worth(row):
                return row
            k = bisect.bisect_left(highest, row)
            after = rows[k] if k < len(rows) else None
            return row if after and OVERHEAD + unit.count(*after) <= OVERHEAD + body else None

        # a page's running header and footer are passages of their own
        at = 0
        for a, b in [(b.start, b.end) for b in blocks if b.kind in ("header", "footer")] + [(len(text), len(text))]:
            walk(at, a, header_at, ends)
            walk(a, b, header_at, ends)
            at = b
    kept = [x for x in found if is_searchable(x[0])]
    return [Chunk(n, *x) for n, x in enumerate(kept)], dropped


def chunk_units(units: DataFrame, keys: list[str], text_col: str = "search_text", table_col: str | None = None, budget: int = BUDGET, overlap: int = OVERLAP, tokenize: Tokenizer = whitespace_tokens, blocks_col: str | None = None) -> DataFrame:
    """keys, chunk, text, start_offset, end_offset, token_count; where table_col holds, the first line is repeated as a header.

    blocks_col: an array of (kind, start, end, rows) with ranges in the text; chunks end at blocks and rows where
    they can, and a chunk that begins within a table has the table's first row before it.
    """
    def given(batch: pa.RecordBatch) -> Iterator[tuple]:
        headed = batch.column(table_col).to_pylist() if table_col else itertools.repeat(False)
        blocks = _blocks(batch.column(blocks_col)) if blocks_col else itertools.repeat(None)
        for text, table, own in zip(batch.column(text_col).to_pylist(), headed, blocks):
            first = text.find("\n") if table and text else -1
            yield text, text[: first + 1] if first > 0 else None, own

    columns = dict.fromkeys([*keys, text_col, *([table_col] if table_col else []), *([blocks_col] if blocks_col else [])])
    return _chunked(units.select(*columns), keys, given, budget, overlap, tokenize)


def chunk_pages(pages: DataFrame, keys: list[str], content: str = "markdown", budget: int = BUDGET, overlap: int = OVERLAP, tokenize: Tokenizer = whitespace_tokens) -> DataFrame:
    """The chunks of pages in Markdown, as chunk_units() gives them of structured() pages with rows: in one step, so that no blocks go from one worker to another."""

    def given(batch: pa.RecordBatch) -> Iterator[tuple]:
        for markdown in batch.column(content).to_pylist():
            text, blocks = structure.place(structure.read_markdown(markdown or ""))
            yield text, None, [Block(b.start, b.end, _PAGE_PARTS.get(b.kind, b.kind), tuple(zip(*(x.tolist() for x in structure.row_ranges(b)), strict=True))) for b in blocks]

    return _chunked(pages.select(*dict.fromkeys([*keys, content])), keys, given, budget, overlap, tokenize)


def _chunked(rows: DataFrame, keys: list[str], given: Callable[[pa.RecordBatch], Iterator[tuple]], budget: int, overlap: int, tokenize: Tokenizer) -> DataFrame:
    """The chunks of each row's (text, header, blocks); a null text has none."""
    schema = T.StructType([
        *(rows.schema[k] for k in keys), T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType()), T.StructField("token_count", T.IntegerType()),
    ])
    fields = [("ordinal", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32())]

    def made(batch: pa.RecordBatch, of: list[int], out: list[Chunk]) -> pa.RecordBatch:
        own = [batch.column(k).take(pa.array(of, pa.int64())) for k in keys]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([getattr(c, f) for c in out], kind) for f, kind in fields)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, (text, header, blocks) in enumerate(given(batch)):
                if text is None:
                    continue
                found = chunk_text(text, header, blocks, budget, overlap, tokenize)[0]
                of += [k] * len(found)
                out += found
                if len(out) > 2000:
                    yield made(batch, of, out)
                    of, out = [], []
            yield made(batch, of, out)

    return rows.mapInArrow(run, schema)


def _blocks(column: pa.ListArray) -> Iterator[list[Block] | None]:
    """Of each row the blocks, one page after the other; null ones are None."""
    names = {f.name: k for k, f in enumerate(column.type.value_type)}
    for own in column:
        if not own.is_valid:
            yield None
            continue
        own = own.values
        kinds, starts, ends = (own.field(names[f]).to_pylist() for f in ("kind", "start", "end"))
        rows = [()] * len(own)
        for k, r in enumerate(own.field(names["rows"])):
            if r.is_valid and len(r):
                v = r.values
                place = {f.name: i for i, f in enumerate(v.type)}
                rows[k] = tuple(zip(v.field(place["start"]).to_pylist(), v.field(place["end"]).to_pylist(), strict=True))
        yield [Block(a, b, _PAGE_PARTS.get(kind, kind), r) for kind, a, b, r in zip(kinds, starts, ends, rows, strict=True)]


def plan_batches(lengths: list[int], most: int = 8192) -> list[tuple[int, int]]:
    """Runs of passages whose padded size (longest times number) stays within a budget."""
    out, first, longest = [], 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n)
        if i > first and longest * (i + 1 - first) > most:
            out.append((first, i))
            first, longest = i, n
    return [*out, (first, len(lengths))] if lengths else []


def stretches(rows: DataFrame, group: str, key: str, n: str, most: int = 8192) -> DataFrame:
    """(group, lengths): each group's lengths in the order of the key, cut where a run of plan_batches must begin.

    A passage of more than half the budget shares no run with those before it, so stretches that begin
    with one are planned by themselves as they are within the whole group. Range partitions are cut by
    themselves; only what stands before the first and after the last cut of a partition is joined with what its neighbours have there.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at, out = None, (None, None), []
        certain = first = True
        for pdf in batches:
            for g, k, size in zip(pdf[group], pdf[key], pdf[n], strict=True):
                if own is None or g != at[0] or 2 * size > most:
                    if own is not None:
                        out.append((*at, own, not certain))
                    own, at, certain, first = [], (g, k), not first or 2 * size > most, False
                own.append(size)
            yield pd.DataFrame(out, columns=["g", "place", "lengths", "open"])
            out = []
        if own is not None:
            yield pd.DataFrame([(*at, own, True)], columns=["g", "place", "lengths", "open"])

    kinds = dict(rows.dtypes)
    ordered = rows.select(group, key, F.coalesce(n, F.lit(0)).cast("int").alias(n)).repartitionByRange(group, key).sortWithinPartitions(group, key, n)
    found = ordered.mapInPandas(pieces, f"g {kinds[group]}, place {kinds[key]}, lengths array<int>, open boolean")
    joined = found.groupBy("g", F.when(~F.col("open"), F.col("place"))).agg(F.array_sort(F.collect_list(F.struct("place", "lengths"))).alias("x"))
    return joined.select(F.col("g").alias(group), F.flatten(F.transform("x", lambda x: x["lengths"])).alias("lengths"))
